"""Sharding, quality rules and mixing: against SQL, and on messy rows."""

import bisect
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from blockstrata.llm import mixing, quality, queries, sharding


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for f in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_as_sql(spark, sf_dir, duck, name):
    got, want = queries.queries()[name](spark, sf_dir).toPandas(), duck.sql(queries.oracle_sql()[name]).df()
    clean = lambda df: sorted(tuple("" if str(v) in ("None", "nan", "<NA>") else str(v).removesuffix(".0") for v in r) for r in df[sorted(df.columns)].itertuples(index=False))
    assert sorted(got.columns) == sorted(want.columns) and clean(got) == clean(want)


def test_shards_are_even(documents, messy, empty):
    rows = sharding.shard_documents(documents).toPandas()
    assert rows.groupby("shard").slot.apply(lambda s: sorted(s) == list(range(len(s)))).all()
    total, biggest = rows["size"].sum(), rows["size"].max()
    assert (rows.groupby("shard")["size"].sum() - total / 16).abs().max() <= biggest
    few = sharding.shard_documents(messy, 3).collect()
    assert len(few) == messy.count() and {r["size"] for r in few if r["doc_id"] in (0, 2, 3)} == {1} and all(r["grown_shard"] is None for r in few)
    assert sharding.shard_documents(empty).count() == 0


def test_hot_keys_are_subdivided(spark):
    docs = spark.range(3000).selectExpr("if(id % 3 = 0, 7, id) as doc_id", "if(id % 3 < 2, 'same text', concat('t', id)) as text")
    rows = sharding.shard_documents(docs).toPandas()
    per = rows.groupby("shard")["size"].sum()
    assert len(per) == 16 and per.max() - per.min() <= 2 * rows["size"].max() and not rows.duplicated(["shard", "slot"]).any()


@pytest.mark.parametrize("ranges", [64, 400])
def test_no_divisible_range_is_overfull(spark, ranges):
    """A third of the rows has one text, and a few rows are larger than many shares."""
    rows = spark.range(20_000).selectExpr(
        "if(id % 3 = 0, 'hot', md5(string(id))) as _key", "id as _id", "id as _row", "bigint(case when id % 5000 = 7 then 400000 when id % 3 = 0 then 1 + id % 4 * 90 else 1 + pow(id % 97, 2) / 40 end) as size"
    )
    keyed = rows.selectExpr("struct(_key, _id, _row) as _k", "size").cache()
    total = keyed.agg(F.sum("size")).first()[0]
    bounds = sharding.boundaries(keyed, total, ranges)
    own = sorted((tuple(r[0]), r[1]) for r in keyed.collect())
    sizes = {}
    for k, size in own:
        sizes.setdefault(bisect.bisect_right(bounds, k), []).append(size)
    assert all(sum(v) - max(v) <= 2 * total / ranges for v in sizes.values())
    assert bounds == sorted(set(bounds)) and len(bounds) < 4 * ranges


def test_rounds_draw_anew(spark):
    keyed = spark.range(4000).selectExpr("struct(md5(string(id)) as _key, id as _id, id as _row) as _k", "10L as size")
    a, b = (set(sharding._draws(keyed, 100.0, n)) for n in (0, 1))
    assert 300 < len(a) < 500 and 300 < len(b) < 500 and len(a & b) < 100


def test_quality_on_messy_rows(messy, empty, labels):
    rows = quality.judge_documents(messy, labels).collect()
    assert len(rows) == messy.count()
    by = {r["doc_id"]: r for r in rows}
    assert by[2]["n_words"] == by[3]["n_words"] == by[5]["word_chars"] == 0 and by[2]["base_failed"] and not by[2]["kept"]
    assert by[1]["kept"] and by[8]["n_words"] == 60_000 and by[9]["word_chars"] == 300_000 and by[9]["base_failed"]
    assert quality.judge_documents(empty, labels).count() == 0
    kept = quality.keep_documents(messy, labels)
    assert kept.columns == messy.columns and kept.count() == sum(r["kept"] for r in rows)


def brute_repeats(words):
    grams = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    hit = set()
    for i, g in enumerate(grams):
        if grams.count(g) > 1:
            hit |= set(range(i, i + 8))
    return len(hit)


def test_repeated_words(spark):
    import random

    rng = random.Random(2)
    texts = [" ".join(rng.choice("ab" if n % 2 else "abcd") for _ in range(n)) for n in range(0, 60, 3)]
    rows = quality.with_counts(spark.createDataFrame([(t,) for t in texts], "text string")).collect()
    assert {r["text"]: r["n_repeat_words"] for r in rows} == {t: brute_repeats(t.split()) for t in texts}


def test_cutoffs_hold_their_risk(spark):
    """Good documents have few symbols, bad ones many: cut off between, and nowhere without labels enough."""
    docs = spark.range(6000).selectExpr("id as doc_id", "if(id < 5000, 'en', 'xx') as lang", "concat(repeat('word ', 0), array_join(transform(sequence(1, 40), i -> concat('w', id, 'x', i, if(id % 5 = 0, '###', ''))), ' ')) as text")
    labels = docs.selectExpr("doc_id", "if(doc_id % 5 = 0, 0, 1) as quality").where("lang = 'en' or doc_id < 5040")
    rows = quality.judge_documents(docs, labels).toPandas()
    english = rows[rows.doc_id < 5000]
    assert not english[english.doc_id % 5 == 0].kept.any() and english[english.doc_id % 5 != 0].kept.all()
    assert rows[rows.doc_id >= 5000].kept.all()


def test_certified_cutoffs_match_sql(spark, sf_dir, tmp_path):
    """The tables themselves, often enough, with new ids and with noise in some, for labels to certify cutoffs: the SQL
    must see them in two strata or more and agree on every row."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("length(text) between 130 and 600")
    some = docs.crossJoin(spark.range(160).toDF("copy")).withColumn("new_id", F.col("doc_id") * 1000 + F.col("copy"))
    noise = F.when(F.col("copy") % 12 == 0, F.concat(F.col("text"), F.lit(" "), F.repeat(F.lit("#$&|"), 100))).otherwise(F.col("text"))
    some.select(F.col("new_id").alias("doc_id"), noise.alias("text"), F.when(F.col("doc_id") % 2 == 0, "en").alias("lang"), "source", "n_chars").write.parquet(str(tmp_path / "documents"))
    some.selectExpr("new_id as doc_id", "if(copy % 12 = 0, 0, 1) as quality", "0 as toxic").write.parquet(str(tmp_path / "labels"))
    docs, labels = (spark.read.parquet(str(tmp_path / t)) for t in ("documents", "labels"))
    counted = quality.with_counts(docs)
    cuts = quality.cutoffs(counted, labels, "doc_id", "lang").toPandas()
    assert cuts.drop(columns="_stratum").notna().any(axis=1).sum() >= 2
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}/*.parquet'")
    want = dict(con.sql(f"SELECT doc_id, kept FROM ({queries.oracle_sql()['op7_quality']})").fetchall())
    got = {r["doc_id"]: (r["kept"], r["base_failed"]) for r in quality.judge_documents(docs, labels).collect()}
    assert {d: k for d, (k, _) in got.items()} == want
    assert sum(not k and not base for k, base in got.values()) > 100


def test_binomial_tail():
    import math

    for n, k, p in ((50, 3, 0.2), (400, 0, 0.005), (3000, 9, 0.005)):
        want = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
        assert abs(quality.binomial_tail(k, n, p) / want - 1) < 1e-9
    assert quality.binomial_tail(5, 10, 0.1) == 1.0


def test_mix(documents, messy, empty):
    rows = mixing.mix_report(messy).collect()
    assert len(rows) == messy.count() and all(r["taken"] <= 2 * r["size"] for r in rows)
    total = sum(r["size"] for r in rows)
    per = {(r["source_size"], r["target"]) for r in rows}
    assert abs(sum(t for _, t in per) - 1.5 * total) < 1e-6 * total and all(t <= 2 * s + 1e-9 for s, t in per)
    assert mixing.mix_report(empty).count() == 0 and mixing.mix_documents(empty).count() == 0
    mixed = mixing.mix_documents(documents)
    assert mixed.columns == documents.columns
    want = {r["doc_id"]: r["taken"] // r["size"] for r in mixing.mix_report(documents).collect() if r["taken"]}
    assert {r["doc_id"]: r["count"] for r in mixed.groupBy("doc_id").count().collect()} == want
    assert mixing.mix_documents(messy).columns == messy.columns


def test_shared_folder(spark, tmp_path, monkeypatch):
    from blockstrata.llm import store

    monkeypatch.setattr(store, "shared_dir", lambda spark: f"file://{tmp_path}/shared")
    monkeypatch.setattr(store, "_made", [])
    a, b = store.settle(spark.range(5).toDF("x"), "a"), store.settle(spark.range(3).toDF("x"), "b")
    assert len(list((tmp_path / "shared").iterdir())) == 2 and a.count() == 5
    store.discard(a)
    assert [p.name.split("-")[1] for p in (tmp_path / "shared").iterdir()] == ["b"] and b.count() == 3
    store.clear(spark)
    assert not list((tmp_path / "shared").iterdir())
