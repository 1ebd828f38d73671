"""Suffix arrays and suffix automata against brute force over windows."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from pyspark.sql import functions as F

from blockstrata.llm import automaton_dedup, passage_tables, passages, suffix_dedup
from tests.llm.conftest import prose


def brute_bytes(texts, length=200):
    count = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if count[t[i : i + length]] > 1:
                gone[i : i + length] = True
        left = np.frombuffer(t, "u1")[~gone].tobytes()
        out.append((len(t), int(gone.sum()), int((np.diff(gone.astype("i1"), prepend=0) == 1).sum()), hashlib.sha256(left).hexdigest()))
    return out


def brute_words(rows, length=50):
    words, first = [(d, t.split()) for d, t in rows], {}
    for d, w in words:
        for i in range(len(w) - length + 1):
            first[b" ".join(w[i : i + length])] = min(d, first.get(b" ".join(w[i : i + length]), d))
    out = {}
    for d, w in words:
        gone = np.zeros(len(w), bool)
        for i in range(len(w) - length + 1):
            if first[b" ".join(w[i : i + length])] < d:
                gone[i : i + length] = True
        kept = [x for x, g in zip(w, gone, strict=True) if not g]
        out[d] = (len(w), int(gone.sum()), hashlib.sha256(b" ".join(kept)).hexdigest())
    return out


@pytest.mark.parametrize(("crowd", "shard"), [(4096, 1 << 20), (1, 3000)])
def test_bytes(documents, texts, monkeypatch, crowd, shard):
    monkeypatch.setattr(passage_tables, "CROWD", crowd)
    monkeypatch.setattr(suffix_dedup, "SHARD", shard)
    want = dict(zip([i for i, _ in texts], brute_bytes([t.encode() for _, t in texts]), strict=True))
    assert {r[0]: tuple(r[1:]) for r in suffix_dedup.report(documents).collect()} == want


@pytest.mark.parametrize(("crowd", "shard"), [(4096, 30_000), (1, 400)])
def test_words(documents, texts, monkeypatch, crowd, shard):
    monkeypatch.setattr(passage_tables, "CROWD", crowd)
    monkeypatch.setattr(automaton_dedup, "SHARD", shard)
    got = {r[0]: tuple(r[1:]) for r in automaton_dedup.report(documents).collect()}
    assert got == brute_words([(i, t.encode()) for i, t in texts])


def _repetitive(seed):
    rng = random.Random(seed)
    base = [bytes(rng.choice(b"ab") for _ in range(300)) for _ in range(12)]
    return [rng.choice(base)[rng.randint(0, 60) :][: rng.randint(150, 290)] + bytes(rng.choice(b"abc") for _ in range(rng.randint(0, 30))) for _ in range(150)]


@pytest.mark.parametrize("seed", [1, 2])
def test_shards_merge(seed):
    texts = _repetitive(seed)
    counts = [1 + (i % 7 == 0) for i in range(len(texts))]
    total = Counter()
    for t, n in zip(texts, counts, strict=True):
        for i in range(len(t) - 199):
            total[t[i : i + 200]] += n
    seen = lambda s, ts: all(bool(s.seen[a + i]) == (total[t[i : i + 200]] > 1) for t, a in zip(ts, s.starts, strict=True) for i in range(len(t) - 199))
    assert seen(suffix_dedup.Shard(texts, counts), texts)
    a, b = suffix_dedup.Shard(texts[:60], counts[:60]), suffix_dedup.Shard(texts[60:], counts[60:])
    a.meet(b)
    assert seen(a, texts[:60]) and seen(b, texts[60:])


def test_suffix_order_and_prefixes():
    texts = _repetitive(3)[:20]
    s = suffix_dedup.Shard(texts, [1] * len(texts))
    order = [s.sym[i : i + 200].tolist() for i in s.sa]
    assert order == sorted(order)


def repeated(shard, texts, depth):
    count = Counter(t[i : i + depth] for t in texts for i in range(len(t) - depth + 1))
    return all(bool(shard.seen[a + i]) == (count[t[i : i + depth]] > 1) for t, a in zip(texts, shard.starts, strict=True) for i in range(len(t) - depth + 1))


def test_chain_after_an_empty_prefix():
    """Neighbours that differ in their first byte, and those one further that share what follows."""
    assert repeated(suffix_dedup.Shard([b"x1yz", b"x2yz"], [1, 1], 2), [b"x1yz", b"x2yz"], 2)
    rng = random.Random(6)
    for _ in range(300):
        texts = [bytes(rng.choice(b"abcd") for _ in range(rng.randint(1, 12))) for _ in range(6)]
        assert repeated(suffix_dedup.Shard(texts, [1] * 6, 3), texts, 3)


def test_one_byte_substituted(spark):
    rng = random.Random(8)
    texts = []
    for i in range(20):
        x, w = (bytes(rng.choice(b"cdefgh") for _ in range(n)) for n in (rng.choice([1, 90, 250]), 230))
        # The byte and what follows it are the last of theirs in one text and the first of theirs in the other.
        texts += [x + bytes([65 + 2 * i]) + w, x + bytes([66 + 2 * i]) + w]
    assert repeated(suffix_dedup.Shard(texts, [1] * len(texts)), texts, 200)
    df = spark.createDataFrame([(i, t.decode("latin-1")) for i, t in enumerate(texts)], "doc_id bigint, text string")
    got = {r[0]: tuple(r[1:]) for r in suffix_dedup.report(df).collect()}
    assert [got[i] for i in range(len(texts))] == brute_bytes([t.decode("latin-1").encode() for t in texts])


def test_automaton(monkeypatch):
    monkeypatch.setattr(automaton_dedup, "LENGTH", 3)
    rng = random.Random(4)
    docs = [(d, [rng.randint(0, 2) for _ in range(rng.randint(1, 40))]) for d in range(25)]
    a, first = automaton_dedup.Automaton(), {}
    for d, w in docs:
        a.add(w, d)
        for i in range(len(w) - 2):
            first.setdefault(tuple(w[i : i + 3]), d)
    for _, w in docs:
        assert a.earliest(w) == [first[tuple(w[i : i + 3])] for i in range(len(w) - 2)]
    assert a.earliest([9, 0, 9, 9]) == [None, None]


def test_messy(messy, empty, spark):
    got = {(r["doc_id"], r["n_removed"]) for r in suffix_dedup.report(messy).collect()}
    long = len("x") * 300_000
    assert {(9, long), (2, 0), (3, 0), (0, 0)} <= got and len(suffix_dedup.report(messy).collect()) == messy.count()
    by = {r["doc_id"]: r for r in suffix_dedup.report(messy).collect()}
    assert by[1]["n_removed"] == by[1]["n_bytes"] == by[4]["n_removed"] and by[10]["n_removed"] > 0
    assert suffix_dedup.report(empty).count() == 0
    left = suffix_dedup.clean(messy)
    assert left.columns == messy.columns and left.count() == messy.count()
    rows = {r["doc_id"]: r for r in left.collect()}
    assert rows[1]["text"] == "" and rows[1]["n_chars"] == 0 and rows[2]["text"] is None and rows[6]["text"] == "Word"
    words = automaton_dedup.report(messy).collect()
    assert len(words) == messy.count() and automaton_dedup.report(empty).count() == 0
    by = {r["doc_id"]: r for r in words}
    assert by[4]["n_removed"] == by[4]["n_words"] == 300 and by[1]["n_removed"] == 0 and by[11]["n_removed"] == 80 and by[2]["n_words"] == 0


def test_words_of_one_hash_differ(spark):
    """A long word and its complement share the polynomial that anchors are chosen by, but not their content."""
    bits = [bin(i).count("1") & 1 for i in range(1024)]
    pair = ["".join("ab"[b ^ flip] for b in bits) for flip in (0, 1)]
    units = [passages.sums(np.frombuffer(w.encode(), "u1").astype("u8")) for w in pair]
    assert len({int(passages.span_hash(u, np.array([0]), np.array([1024]))[0]) for u in units}) == 1
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join([*words[:30], w, *words[31:]])) for i, w in enumerate(pair)]
    got = automaton_dedup.report(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert [r["n_removed"] for r in got] == [0, 0]


def test_repeated_rows_are_counted_not_listed(spark, monkeypatch):
    """2,000 rows of one id and text, and an earlier document with half of it: lists stay as long as the text asks for."""
    text, sizes = prose(3, 300), []
    df = spark.createDataFrame([(7, text)] * 2000 + [(1, text[: len(text) // 2])], "doc_id bigint, text string").repartition(4)
    for module, found in ((suffix_dedup, suffix_dedup.ranges_by_document), (automaton_dedup, automaton_dedup.windows_to_remove)):
        got = found(df.select(*passage_tables.keys_of(df, "doc_id", "text")))
        sizes.append(got.select(F.max(F.size(got.columns[-1]))).first()[0])
        rows = {(r["doc_id"], r["n_removed"]) for r in module.report(df).collect()}
        assert len(rows) == 2 and module.report(df).count() == 2001
    assert max(sizes) < 200


@pytest.mark.parametrize("piece", [600, 5000])
def test_long_texts_in_parts(documents, texts, monkeypatch, piece):
    monkeypatch.setattr(passage_tables, "PIECE", piece)
    want = dict(zip([i for i, _ in texts], brute_bytes([t.encode() for _, t in texts]), strict=True))
    assert {r[0]: tuple(r[1:]) for r in suffix_dedup.report(documents).collect()} == want
    got = {r[0]: tuple(r[1:]) for r in automaton_dedup.report(documents).collect()}
    assert got == brute_words([(i, t.encode()) for i, t in texts])


def test_parts_of_a_text():
    text = (" ".join("abcdefgh"[i % 8] * (1 + i % 5) for i in range(900)) + "  \t" + "x" * 700 + " end").encode()
    words = text.split()
    for size in (10, 300, 10_000):
        windows = []
        for before, part in automaton_dedup.Words().cut(text, size):
            own = part.split()
            assert words[before : before + len(own)] == own
            windows += range(before, before + len(own) - 49)
        assert windows == list(range(len(words) - 49))
        places = [(at + i, part[i : i + 200]) for at, part in suffix_dedup.Bytes().cut(text, size) for i in range(len(part) - 199)]
        assert places == [(i, text[i : i + 200]) for i in range(len(text) - 199)]


def test_ids_are_whole_numbers(spark):
    df = spark.createDataFrame([("a", "x")], "doc_id string, text string")
    for report in (suffix_dedup.report, automaton_dedup.report, suffix_dedup.clean):
        with pytest.raises(TypeError, match="whole numbers"):
            report(df)
