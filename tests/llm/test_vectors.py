import numpy as np
from pyspark.sql import functions as F

from blockstrata.llm import hnsw


def brute(rows, queries, k=10):
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], "f8")
    out = {}
    for q, v in queries:
        d = np.sqrt(((x - np.array(v, "f8")) ** 2).sum(1))
        out[q] = [(int(ids[j]), float(d[j])) for j in np.lexsort((ids, d)) if ids[j] != q][:k]
    return out


def test_recall(spark, monkeypatch):
    monkeypatch.setattr(hnsw, "SHARD", 400)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(30, 24))
    x = (centres[rng.integers(0, 30, 2000)] + 0.5 * rng.normal(size=(2000, 24))).astype("f4")
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id bigint, embedding array<float>")
    got = hnsw.nearest(df, df.where("vec_id % 40 = 0")).collect()
    want = brute(list(enumerate(x.tolist())), [(i, x[i].tolist()) for i in range(0, 2000, 40)])
    assert len(got) == 500
    exact = {(q, i): s for q, v in want.items() for i, s in v}
    hits = [r for r in got if (r["query_id"], r["vec_id"]) in exact]
    assert len(hits) >= 0.95 * len(got)
    assert all(abs(r["score"] - exact[r["query_id"], r["vec_id"]]) < 1e-12 for r in hits)
    for q in want:
        own = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == list(range(1, 11)) and [(r["score"], r["vec_id"]) for r in own] == sorted((r["score"], r["vec_id"]) for r in own)


def test_messy(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [1.0, 0.0], "x") for i in range(0, 40)] + [(100, [0.0, 2.0], None), (100, [0.0, 2.0], None), (101, None, "y"), (102, [0.0, 0.0], ""), (103, [nan, 1.0], ""), (104, [inf, 1.0], ""), (105, [None, 1.0], ""), (None, [1.0, 1.0], ""), (200, [1.0, 1.0, 1.0], ""), (300, [], "")]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, rank string").withColumnRenamed("rank", "_v")
    df = df.withColumns({c: F.lit("clash") for c in ("_id", "dim", "shard", "block", "points", "q", "score", "query_id", "_ids", "_r")})
    got = hnsw.nearest(df, df.where("vec_id % 100 = 0"), 10).collect()
    by = {}
    for r in got:
        by.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert sorted(by) == [0, 100]
    assert sorted(by[0]) == [(k, k, 0.0) for k in range(1, 11)]
    assert sorted(by[100]) == [(k + 1, k, 5.0**0.5) for k in range(10)]
    assert hnsw.nearest(df.limit(0), df.limit(0)).count() == 0


def test_few_candidates(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0]), (2, [4.0])], "vec_id bigint, embedding array<double>")
    got = hnsw.nearest(df, df.where("vec_id = 0")).collect()
    assert [(r["rank"], r["vec_id"], r["score"]) for r in got] == [(1, 1, 1.0), (2, 2, 3.0)]


def test_recall_of_the_query(spark):
    """The registered query on its whole table, against brute force."""
    from blockstrata.llm import queries

    at = "/root/testdata/sf0.1"
    rows = sorted((r[0], r[1]) for r in spark.read.parquet(f"{at}/embeddings.parquet").select("vec_id", "embedding").collect() if r[1] and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1]))
    got = {(r["query_id"], r["vec_id"]) for r in queries.op4_hnsw(spark, at).collect()}
    want = {(q, i) for q, near in brute(rows, [r for r in rows if r[0] % 100 == 0]).items() for i, _ in near}
    assert len(got & want) >= 0.95 * len(want) > 0
