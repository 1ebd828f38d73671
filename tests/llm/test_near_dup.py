import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from blockstrata.llm import near_dup
from blockstrata.llm.components import components


def brute_fingerprint(text, k):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    shingles = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    count = [sum(xxhash.xxh64_intdigest(s, 42) >> b & 1 for s in shingles) for b in range(64)]
    return sum(1 << b for b in range(64) if count[b] * 2 > len(shingles))


def brute_components(fps, ids, bits):
    f = np.array(fps, "u8")
    near = np.bitwise_count(f[:, None] ^ f[None]) <= bits
    comp = list(range(len(fps)))
    while True:
        new = [min((comp[j] for j in np.flatnonzero(near[i])), key=lambda j: ids[j]) for i in range(len(fps))]
        if new == comp:
            return [ids[c] for c in comp]
        comp = new


@pytest.mark.parametrize(("k", "bits"), [(4, 4), (5, 5), (4, 8)])
def test_against_brute_force(documents, texts, k, bits):
    ids, fps = [i for i, _ in texts], [brute_fingerprint(t, k) for _, t in texts]
    want = dict(zip(ids, zip([f"{f:016x}" for f in fps], brute_components(fps, ids, bits), strict=True), strict=True))
    got = near_dup.near_dups(documents, shingle=k, bits=bits).collect()
    assert {r[0]: (r[1], r[2]) for r in got} == want


@pytest.mark.parametrize("bits", [2, 4, 5, 8])
def test_close_pairs_meet_at_an_anchor(spark, bits):
    rng = np.random.default_rng(bits)
    x = rng.integers(0, 2**64, 500, dtype="u8")
    y = x.copy()
    for i in range(500):
        for b in rng.choice(64, bits, replace=False):
            y[i] ^= np.uint64(1 << int(b))
    df = spark.createDataFrame(list(zip(x.view("i8").tolist(), y.view("i8").tolist(), strict=True)), "x bigint, y bigint")
    shared = F.size(F.array_intersect(near_dup.anchors(F.col("x"), bits), near_dup.anchors(F.col("y"), bits)))
    assert df.select(F.min(shared)).first()[0] >= 1


def test_crowded_anchor(monkeypatch):
    rng = np.random.default_rng(1)
    fps = np.unique(rng.integers(0, 2**12, 900, dtype="u8") << np.uint64(40))
    monkeypatch.setattr(near_dup, "LARGE", 64)
    a, b = near_dup._compare(np.zeros(len(fps), "i8"), fps, 2)
    root = {int(f): int(f) for f in fps}
    root |= dict(zip(a.tolist(), b.tolist(), strict=True))
    want = brute_components(fps.tolist(), fps.tolist(), 2)
    assert [root[f] for f in fps.tolist()] == want
    assert len(a) < len(fps)


def test_messy(spark, messy, empty):
    got = near_dup.near_dups(messy, shingle=4, bits=4)
    rows = got.collect()
    assert len(rows) == messy.count() and got.columns == ["doc_id", "fingerprint", "component_id"]
    by = {r["doc_id"]: r for r in rows}
    assert {by[i]["component_id"] for i in (0, 2, 3, 5)} == {0} and by[0]["fingerprint"] == "0" * 16
    assert by[4]["component_id"] == by[1]["component_id"] == 1 and by[7]["component_id"] == 6 and by[None]["component_id"] is None
    assert near_dup.near_dups(empty).count() == near_dup.similar_dups(empty).count() == 0
    kept = near_dup.drop_near_dups(messy)
    assert kept.columns == messy.columns
    assert sorted((r[0] is None, r[0] or 0) for r in kept.select("doc_id").collect()) == [(False, i) for i in (-12, 0, 1, 6, 8, 9, 10, 11)] + [(True, 0)]


def test_components(spark):
    chain = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (103, 101), (200, 200)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(chain, "a bigint, b bigint")).collect()}
    assert got == {i: 0 for i in range(1, 61)} | {101: 100, 103: 100}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_similar_texts(spark):
    """Edited copies at several similarities, among unrelated texts."""
    import random

    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    rows, share = [], {}
    for i in range(400):
        text = [word() for _ in range(400)]
        edits = (2, 5, 8, 60)[i % 4]
        copy = list(text)
        for at in rng.sample(range(400), edits):
            copy[at] = word()
        grams = [{tuple(t[k : k + 5]) for k in range(396)} for t in (text, copy)]
        share[i] = len(grams[0] & grams[1]) / len(grams[0] | grams[1])
        rows += [(2 * i, " ".join(text)), (2 * i + 1, " ".join(copy))]
    got = {r["doc_id"]: r["component_id"] for r in near_dup.similar_dups(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    linked = {i: got[2 * i + 1] == 2 * i for i in share}
    assert all(got[2 * i] == 2 * i for i in share) and all(got[2 * i + 1] in (2 * i, 2 * i + 1) for i in share)
    rate = lambda lo, hi: (lambda v: sum(v) / len(v))([linked[i] for i, s in share.items() if lo <= s < hi])
    assert rate(0.9, 1) == rate(0.8, 0.9) == 1 and rate(0, 0.8) == 0


def brute_alike(texts):
    """Least row of each one's component, by the definition of similarity on words."""
    words = ["".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").split() for t in texts]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in words]
    near = [[i == j or len(a & b) * 5 >= len(a | b) * 4 for j, b in enumerate(sets)] for i, a in enumerate(sets)]
    comp = list(range(len(texts)))
    while (new := [min(comp[j] for j, x in enumerate(row) if x) for row in near]) != comp:
        comp = new
    return comp


def around(rng, pairs, n=116):
    """Pairs of texts whose similarity lies on both sides of 0.8, and close to it."""
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    out = []
    for i in range(pairs):
        text = [word() for _ in range(n)]
        copy = list(text)
        at = rng.randrange(n - 30)
        copy[at : at + 5 + i % 6] = [word() for _ in range(5 + i % 6)]
        if i % 2:
            copy = [word() for _ in range(2 + i % 3)] + copy
        out += [" ".join(text), " ".join(copy)]
    return out


@pytest.mark.parametrize("block", [1024, 3])
def test_similar_is_exact(spark, monkeypatch, block):
    """Just those at 0.8 or more are linked: pairs, a chain of small steps, and a crowd that is compared in blocks."""
    import random

    monkeypatch.setattr(near_dup, "BLOCK_SETS", block)
    rng = random.Random(7)
    texts = around(rng, 150)
    chain = [str(rng.random()) for _ in range(100)]
    texts += [" ".join(chain[i * 5 :] + [f"{i}x{j}" for j in range(i * 5)]) for i in range(12)]
    texts += [" ".join(chain[:40] + [str(rng.random()) for _ in range(rng.choice([3, 20]))]) for i in range(30)] + [None, "", " ", "One", "one"]
    got = {r[0]: r[2] for r in near_dup.similar_dups(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    want = brute_alike(texts)
    assert [got[i] for i in range(len(texts))] == want and len(set(want[:300])) in range(160, 290)


def test_bands():
    """As many pairs at just 0.8 share a band as least hashes that are independent give."""
    rng = np.random.default_rng(3)
    shared = []
    for _ in range(300):
        x = rng.integers(0, 2**64, 110, dtype="u8")
        shared.append(sum(a == b for a, b in zip(near_dup.bands(x[:99]), near_dup.bands(x[11:]), strict=True)))
    assert abs(np.mean(shared) / near_dup.BANDS - 0.8**4) < 0.02 and min(shared) > 0
    assert near_dup.bands(x[:0]) == near_dup.bands(x[:0])


@pytest.mark.parametrize("find", [near_dup.near_links, near_dup.similar_links])
def test_drop_keeps_a_row_of_each_component(spark, find):
    """Unrelated texts under a null and under a shared id stay, also if the id is the least of another component."""
    texts = [" ".join(f"{c}{i}" for i in range(80)) for c in "abcdefgh"]
    rows = [(None, texts[0]), (None, texts[1]), (None, texts[1]), (None, texts[2]), (7, texts[3]), (7, texts[4]), (7, texts[4]), (3, texts[5]), (7, texts[5]), (None, texts[5]), (None, texts[6]), (9, texts[6]), (None, None)]
    got = near_dup.drop_near_dups(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3), find).collect()
    want = [(None, texts[0]), (None, texts[1]), (None, texts[2]), (7, texts[3]), (7, texts[4]), (3, texts[5]), (9, texts[6]), (None, None)]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_close_fingerprints_are_candidates(spark, monkeypatch):
    """Alike texts whose fingerprints are close are linked by way of anchors, also if no band brings them together."""
    import random

    monkeypatch.setattr(near_dup, "_stars", lambda batches: iter([None for _ in batches][:0]))
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    rows, close = [], []
    for i in range(40):
        text = [word() for _ in range(300)]
        copy = [*text[:150], word(), *text[151:]]
        rows += [(2 * i, " ".join(text)), (2 * i + 1, " ".join(copy))]
        close.append((brute_fingerprint(rows[-1][1], 5) ^ brute_fingerprint(rows[-2][1], 5)).bit_count() <= 5)
    got = {r[0]: r[2] for r in near_dup.similar_dups(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert [got[2 * i + 1] == 2 * i for i in range(40)] == close and sum(close) > 20
