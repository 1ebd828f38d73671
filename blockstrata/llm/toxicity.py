"""Toxicity by a factorization machine over hashed terms.

A term is a lower-cased word or, for longer words, its first four or five characters. Terms are hashed to
buckets. Inputs, present or absent, are the buckets that set the labels apart on their own and those that do so
only together with another one: of the frequent terms, all pairs are counted by label. Besides a weight, each
input has a short vector, and the product of two vectors weighs the pair: an insult that counts only beside the
mention of a group is learnt as such, which additive weights can't do.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Labelled rows that the fit uses at most (about: they are drawn by a hash of the id), buckets, length of vectors.
SAMPLE, BUCKETS, RANK = 20_000, 1 << 20, 8
#: Standard errors that make an effect: of a bucket in LEAST documents or more, and of a pair all of whose four cells
#: have CELL documents or more. Pairs are told among the PAIRS most frequent buckets: rarer ones seldom meet.
ALONE, LEAST, TOGETHER, CELL, PAIRS = 3, 4, 10, 20, 4096
EPOCHS, RATE, SHRINK = 15, 0.15, 1e-5
FOLDS = 5
_WORD = re.compile(r"[^\W_]+")
_CACHE = 200_000


def terms(word: str) -> list[str]:
    return [f"w {word}"] + [f"{n} {word[:n]}" for n in (4, 5) if len(word) > n]


def buckets(word: str) -> tuple[int, ...]:
    import xxhash

    return tuple(xxhash.xxh32_intdigest(t) % BUCKETS for t in terms(word))


class _Inputs:
    """Texts to sorted distinct inputs; remembers what words hash to, as far as the cache goes."""

    def __init__(self, chosen: dict[int, int] | None):
        self.chosen, self.known = chosen, {}

    def __call__(self, text: str | None) -> list[int]:
        found: set[int] = set()
        if len(self.known) > _CACHE:
            self.known.clear()
        for word in set(_WORD.findall((text or "").lower())):
            got = self.known.get(word)
            if got is None:
                got = buckets(word)
                if self.chosen is not None:
                    got = tuple(self.chosen[b] for b in got if b in self.chosen)
                self.known[word] = got
            found.update(got)
        return sorted(found)


class Machine:
    def __init__(self, bias: float, weights: np.ndarray, vectors: np.ndarray):
        self.bias, self.weights, self.vectors = bias, weights, vectors

    def margin(self, flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Per row: bias + sum of weights + sum over pairs of inputs of their vectors' product."""
        row = np.repeat(np.arange(len(sizes)), sizes)
        out = self.bias + np.bincount(row, self.weights[flat], len(sizes))
        for f in range(self.vectors.shape[1]):
            v = self.vectors[flat, f]
            s = np.bincount(row, v, len(sizes))
            out += (s * s - np.bincount(row, v * v, len(sizes))) / 2
        return out

    @classmethod
    def fit(cls, rows: list[np.ndarray], y: np.ndarray, inputs: int) -> Machine:
        """Logistic loss, adaptive steps over mini-batches, in an order that is the same each time."""
        rng = np.random.default_rng(5)
        share = min(max(y.mean() if len(y) else 0.5, 1e-3), 1 - 1e-3)
        bias, weights, vectors = math.log(share / (1 - share)), np.zeros(inputs), rng.normal(0, 0.02, (RANK, inputs))
        gb, gw, gv = 1e-2, np.full(inputs, 1e-2), np.full((RANK, inputs), 1e-2)
        for _ in range(EPOCHS if len(y) else 0):
            order = rng.permutation(len(rows))
            for at in range(0, len(order), 256):
                own = order[at : at + 256]
                n, sizes = len(own), np.array([len(rows[i]) for i in own])
                row = np.repeat(np.arange(n), sizes)
                # What follows touches the batch's inputs alone.
                used, flat = np.unique(np.concatenate([rows[i] for i in own]).astype("i8"), return_inverse=True)
                w, v = weights[used], vectors[:, used]
                m = cls(bias, w, v.T)
                error = (1 / (1 + np.exp(-np.clip(m.margin(flat, sizes), -30, 30))) - y[own]) / n
                e = error[row]
                dw = np.bincount(flat, e, len(used)) + SHRINK * w
                gw[used] += dw * dw * n
                weights[used] -= RATE * dw * math.sqrt(n) / np.sqrt(gw[used])
                for f in range(RANK):
                    one = v[f][flat]
                    dv = np.bincount(flat, e * (np.bincount(row, one, n)[row] - one), len(used)) + SHRINK * v[f]
                    gv[f, used] += dv * dv * n
                    vectors[f, used] -= RATE / 2 * dv * math.sqrt(n) / np.sqrt(gv[f, used])
                db = error.sum()
                gb += db * db * n
                bias -= RATE * db * math.sqrt(n) / math.sqrt(gb)
        return cls(bias, weights, vectors.T.copy())


def effects(sets: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """Buckets whose share of documents differs between labels."""
    flat, label = np.concatenate([*sets, np.zeros(0, "i4")]), np.repeat(y, [len(s) for s in sets])
    count = np.stack([np.bincount(flat[label == c], minlength=BUCKETS) for c in (0, 1)]).astype("f8")
    n = np.maximum([(y == 0).sum(), (y == 1).sum()], 1).astype("f8")
    p = count.sum(0) / n.sum()
    z = np.abs(count[1] / n[1] - count[0] / n[0]) / np.sqrt(np.maximum(p * (1 - p), 1e-12) * (1 / n).sum())
    return np.flatnonzero((z > ALONE) & (count.sum(0) >= LEAST))


def pair_effects(sets: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """Frequent buckets that are part of a pair: its toxic share with both, less those with one, plus that with neither."""
    count = np.bincount(np.concatenate([*sets, np.zeros(0, "i4")]), minlength=BUCKETS)
    top = np.argsort(-count, kind="stable")[:PAIRS]
    top = np.sort(top[count[top] >= CELL])
    place, k = np.full(BUCKETS, -1, "i4"), len(top)
    place[top] = np.arange(k)
    both, toxic = np.zeros((k, k), "f4"), np.zeros((k, k), "f4")
    for at in range(0, len(sets), 1024):
        own = [p[p >= 0] for p in (place[s] for s in sets[at : at + 1024])]
        there = np.zeros((len(own), k), "f4")
        there[np.repeat(np.arange(len(own)), [len(o) for o in own]), np.concatenate(own)] = 1
        both += there.T @ there
        bad = there[y[at : at + 1024] == 1]
        toxic += bad.T @ bad
    n, t, each, ill = float(len(sets)), float((y == 1).sum()), np.diag(both).copy(), np.diag(toxic).copy()
    share, found = t / max(n, 1), np.zeros(k, bool)
    for at in range(0, k, 256):
        b, d, nb, nd = both[at : at + 256], toxic[at : at + 256], each[at : at + 256, None], ill[at : at + 256, None]
        cells = ((d, b, 1), (nd - d, nb - b, -1), (ill - d, each - b, -1), (t - nd - ill + d, n - nb - each + b, 1))
        contrast = sum(sign * a / np.maximum(c, 1) for a, c, sign in cells)
        error = np.sqrt(max(share * (1 - share), 1e-12) * sum(1 / np.maximum(c, 1) for _, c, _ in cells))
        hit = (np.abs(contrast) > TOGETHER * error) & (np.minimum.reduce([c for _, c, _ in cells]) >= CELL)
        found |= hit.any(0)
        found[at : at + 256] |= hit.any(1)
    return top[found]


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> tuple[dict[int, int], Machine]:
    """(bucket -> input, machine) from labelled rows outside the held-out fold.

    At most about SAMPLE ids are drawn, so they are broadcast to the documents, and one task fits the machine.
    """
    known = labels.where(F.col(label_col).isNotNull() & (F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS != 0))
    known = known.groupBy(F.col(id_col).alias("_id")).agg((F.max(label_col) > 0).cast("int").alias("_y"))
    n = known.count()
    drawn = known.where(F.pmod(F.xxhash64("_id"), F.lit(1 << 40)) < F.lit(min(1.0, SAMPLE / max(n, 1)) * float(1 << 40)))
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(drawn), "_id")
    # One text for each id drawn: rows that repeat an id don't lift the bound.
    rows = rows.groupBy("_id", "_y").agg(F.min("_text").alias("_text")).select("_id", "_text", "_y")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inputs = _Inputs(None)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([inputs(t.as_py()) for t in b.column(1)], pa.list_(pa.int32()))], ["_id", "_y", "_b"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = sorted((r["_id"], r["_y"], r["_b"]) for b in batches for r in _packed(b))
        y = np.array([t[1] for t in tables], "i8")
        sets = [np.frombuffer(t[2], "i4") for t in tables]
        chosen = np.union1d(effects(sets, y), pair_effects(sets, y))
        place = np.full(BUCKETS, -1, "i4")
        place[chosen] = np.arange(len(chosen))
        m = Machine.fit([p[p >= 0] for p in (place[s] for s in sets)], y.astype("f8"), len(chosen))
        out = json.dumps({"chosen": chosen.tolist(), "bias": m.bias, "weights": m.weights.tolist(), "vectors": m.vectors.tolist()})
        yield pa.RecordBatch.from_arrays([pa.array([out])], ["model"])

    id_type = docs.schema[id_col].dataType.simpleString()
    got = rows.mapInArrow(hashed, f"_id {id_type}, _y int, _b array<int>").repartition(1).mapInArrow(learn, "model string").first()
    m = json.loads(got[0]) if got else {"chosen": [], "bias": 0.0, "weights": [], "vectors": []}
    return {b: i for i, b in enumerate(m["chosen"])}, Machine(m["bias"], np.array(m["weights"], "f8"), np.array(m["vectors"], "f8").reshape(len(m["weights"]), RANK))


def _packed(batch: pa.RecordBatch) -> Iterator[dict]:
    for i, y, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
        yield {"_id": i, "_y": y, "_b": np.asarray(b.values).astype("i4").tobytes()}


def score_documents(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, held_out (crc32 of the id's digits mod 5 is 0), score in 0 to 1 and predicted.

    Null and empty texts get the score of no terms at all. A null id is not held out and has no label. Of
    contradicting labels the larger counts; null labels are none. Without any labels every score is 0.5.
    Repeated rows score alike. An empty table gives an empty result; other columns play no part.
    """
    chosen, machine = fit(docs, labels, id_col=id_col, text_col=text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inputs = _Inputs(chosen)
        for b in batches:
            rows = [inputs(t.as_py()) for t in b.column(1)]
            flat = np.array([x for r in rows for x in r], "i8")
            margin = machine.margin(flat, np.array([len(r) for r in rows], "i8"))
            score = 1 / (1 + np.exp(-np.clip(margin, -30, 30)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score)], [id_col, "score"])

    slim = docs.select(id_col, F.col(text_col).alias("_text"))
    scored = slim.mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, score double")
    held = F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS == 0, F.lit(False))
    return scored.select(id_col, held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
