"""Every stage against a brute-force version of it, each on what the stage before it kept."""

import sys
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).parent.parent.parent))
import corpus_pipeline  # noqa: E402

from blockstrata.llm import oracle, pieces  # noqa: E402
from blockstrata.llm.mixing import mix_report  # noqa: E402


@pytest.fixture(scope="module")
def kept(spark, sf_dir, tmp_path_factory):
    """What goes into each stage and comes out, by name."""
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), {"documents": spark.read.parquet(f"{sf_dir}/documents.parquet")}
    for name, stage in corpus_pipeline.STAGES:
        at = str(tmp_path_factory.mktemp("stage") / "t")
        stage(spark, docs, sf_dir).write.parquet(at)
        docs = out[name] = spark.read.parquet(at)
    return out


def test_columns(kept):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5 and all(kept[n].dtypes == kept["documents"].dtypes for n in names[:-1])


def test_quality(kept, sf_dir):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    want = {r[0] for r in con.sql(f"SELECT doc_id FROM ({oracle.OP7}) WHERE kept").fetchall()}
    assert {r["doc_id"] for r in kept["quality rules"].collect()} == want


def roots_of(near, ids):
    comp = list(range(len(ids)))
    while (new := [min(comp[j] for j in np.flatnonzero(near[i])) for i in range(len(ids))]) != comp:
        comp = new
    return {ids[c] for c in comp}


def test_near_duplicates_by_similarity(kept):
    """Just the components of similarity 0.8 or more, counted on words."""
    rows = sorted((r["doc_id"], r["text"]) for r in kept["quality rules"].collect())
    words = ["".join(c.lower() if "A" <= c <= "Z" else c for c in t).split() for _, t in rows]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in words]
    near = np.array([[i == j or len(a & b) * 5 >= len(a | b) * 4 for j, b in enumerate(sets)] for i, a in enumerate(sets)])
    got = kept["near duplicates"].collect()
    assert sorted(r["doc_id"] for r in got) == sorted(roots_of(near, [i for i, _ in rows]))
    assert {r["doc_id"]: r["text"] for r in got}.items() <= dict(rows).items()


def test_repeated_passages(kept):
    rows = {r["doc_id"]: r["text"].encode() for r in kept["near duplicates"].collect()}
    count = Counter(t[i : i + 200] for t in rows.values() for i in range(len(t) - 199))
    want = {}
    for d, t in rows.items():
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - 199):
            if count[t[i : i + 200]] > 1:
                gone[i : i + 200] = True
        want[d] = np.frombuffer(t, "u1")[~gone].tobytes().decode("utf-8", "ignore")
    got = kept["repeated passages"].collect()
    assert {r["doc_id"]: r["text"] for r in got} == want and all(r["n_chars"] == len(r["text"]) for r in got)
    assert sum(len(t) for t in want.values()) < sum(len(t.decode()) for t in rows.values())


def test_mixture(kept):
    want = {r["doc_id"]: r["taken"] // r["size"] for r in mix_report(kept["repeated passages"]).collect() if r["taken"]}
    got = {r["doc_id"]: r["count"] for r in kept["mixture"].groupBy("doc_id").count().collect()}
    assert {d: n for d, n in got.items() if d in want} == want


def test_tokens(kept):
    model = pieces.Pieces(**pieces.load(corpus_pipeline.PIECES))
    texts = {r["doc_id"]: r["text"] for r in kept["mixture"].collect()}
    rows = kept["tokens"].collect()
    assert len(rows) == kept["mixture"].count() and all(r["round_trip"] for r in rows)
    assert all(model.decode(np.array(r["ids"], "i4")) == texts[r["doc_id"]].replace("▁", " ") for r in rows)


def test_run_is_the_stages(spark, sf_dir, kept):
    key = lambda df: sorted((r["doc_id"], tuple(r["ids"])) for r in df.collect())
    assert key(corpus_pipeline.run(spark, sf_dir)) == key(kept["tokens"])


def test_odd_rows(spark, messy, labels, tmp_path):
    """Nulls, repeated rows and extra columns go through all stages, also a table without rows."""
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    for docs in (messy, messy.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            at = str(tmp_path / f"{name}-{docs.isEmpty()}")
            stage(spark, docs, str(tmp_path)).write.parquet(at)
            out = spark.read.parquet(at)
            assert name == "tokens" or out.columns == docs.columns
            assert docs.isEmpty() == out.isEmpty()
            docs = out
