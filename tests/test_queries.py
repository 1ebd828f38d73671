"""Every query against its DuckDB SQL."""

import math
from pathlib import Path

import duckdb
import pytest

from blockstrata.save_queries import QUERIES, SQL


@pytest.fixture(scope="session")
def duck(sf_dir):
    con = duckdb.connect()
    for f in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def rows(frame):
    frame = frame[sorted(frame.columns)]
    clean = lambda v: "" if v is None or (isinstance(v, float) and math.isnan(v)) or str(v) in ("<NA>", "NaT") else str(v).removesuffix(".0")
    return list(frame.columns), sorted(tuple(map(clean, r)) for r in frame.itertuples(index=False))


def test_all_have_sql():
    assert QUERIES.keys() == SQL.keys()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_as_sql(spark, sf_dir, duck, name):
    assert rows(QUERIES[name](spark, sf_dir).toPandas()) == rows(duck.sql(SQL[name]).df())
