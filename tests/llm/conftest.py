import random

import duckdb
import pytest
from pyspark.sql import functions as F

WORDS = "the of and to in is ander hashwh ereth tion blehe stand wh er on reon nd or ath ing".split()


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + rng.choice(["", "s", "ed", "ing", ",", "."]) for _ in range(n))


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def texts(sf_dir):
    """(doc_id, text), by id."""
    return duckdb.sql(f"SELECT doc_id, text FROM '{sf_dir}/documents.parquet' ORDER BY 1").fetchall()


MESSY = [
    (1, prose(1, 300), "en", "b", 0), (2, None, "en", "b", 0), (3, "", None, "a", None), (4, prose(1, 300), "de", None, 1), (4, prose(1, 300), "de", None, 1), (5, " \t\n", "en", "a", 2),
    (None, prose(2, 120), "en", "b", 3), (6, "Word", "en", "b", 4), (7, "WORD", "fr", "c", 4), (8, prose(3, 60_000), "en", "c", 5), (9, "x" * 300_000, "en", "c", 5),
    (10, "ü€😀 \x00 ▁▁  " * 40, "es", "é", 6), (11, prose(4, 90) + "\n" + prose(1, 80), "en", "a", 7), (-12, prose(5, 70), "en", "a", 7), (0, None, None, None, None),
]


@pytest.fixture(scope="session")
def messy(spark):
    """Nulls anywhere, empty and very long texts, repeated rows, and columns that have the operators' own names."""
    df = spark.createDataFrame(MESSY, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    extra = "_id _text _row _keep _fp _u1 _u2 _bytes key a b anchor digest size shard slot score rank node root kept ids ranges _size _key _bucket _source fingerprint".split()
    return df.withColumns({c: F.lit(f"clash {c}") for c in extra}).repartition(3)


@pytest.fixture(scope="session")
def empty(messy):
    return messy.limit(0)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (1, 0, 1), (4, None, None), (None, 1, 1), (6, 1, 1), (11, 1, 0)], "doc_id bigint, quality int, toxic int")
