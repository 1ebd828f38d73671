"""Removal of passages that an earlier document has already, by suffix automata of reference shards.

Every document is a reference for those with larger ids, so automata of all shards, sent everywhere, would
grow with the corpus, and every document would have to pass through every one. Instead, windows of LENGTH
words meet by anchors (see passages): a reference shard is the segments of some anchors, each distinct segment
once, under the least id that has it. Only where a window can be found again is it looked for. In a shard, the
segments enter a suffix automaton in order of ids, so a state's first document is the least one with its
strings. Segments are then streamed through: of each window's matching statistic, the state that holds exactly
the last LENGTH words tells the least document with this window. An anchor group that fills several shards is
streamed through the automata of its earlier shards as well.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockstrata.llm.passage_tables import contents, distinct_segments, found_segments, keys_of
from blockstrata.llm.passages import Segments, digests, segments, span_hash, sums
from blockstrata.llm.store import discard, release, settle

LENGTH, ANCHOR = 50, 8
_BLANK = re.compile(rb"[\x20\x09-\x0D]")
#: Words of a reference shard.
SHARD = 30_000


class Words:
    """Words as units of passages. A unit's number is a hash of the word, good for choosing anchors; segments are equal
    if their words are, by a digest of these."""

    length, anchor = LENGTH, ANCHOR

    def cut(self, text: bytes, size: int) -> Iterator[tuple[int, bytes]]:
        at = before = 0
        while True:
            end = _BLANK.search(text, at + size)
            part = text[at : end.start()] if end else text[at:]
            n = len(part.split())
            if end and n < LENGTH:
                size *= 2  # very long words
                continue
            yield before, part
            if not end:
                return
            head = part.rsplit(None, LENGTH - 1)[0]
            at, before = at + len(head), before + n - LENGTH + 1

    def segments(self, texts: list[bytes]) -> tuple[Segments, np.ndarray]:
        own = [t.split() for t in texts]
        words = [w for ws in own for w in ws]
        starts = np.concatenate([[0], np.cumsum([len(ws) for ws in own])]).astype("i8")
        ends = np.cumsum(np.fromiter(map(len, words), "i8", len(words)) + 1) - 1
        begins, joined = np.concatenate([[0], ends[:-1] + 1]).astype("i8"), b" ".join(words)
        units = span_hash(sums(np.frombuffer(joined, "u1").astype("u8")), begins, ends) if len(words) else np.zeros(0, "u8")
        found = segments(units, starts, LENGTH, ANCHOR)
        lo = starts[found.doc] + found.first
        return found, digests(joined, begins[lo], ends[lo + found.windows + LENGTH - 2]) if len(words) else digests(b"", lo, lo)

    def sequence(self, text: bytes) -> list[bytes]:
        return text.split()

    def pack(self, part: list[bytes]) -> bytes:
        return b" ".join(part)


class Automaton:
    """Generalised suffix automaton over word numbers; ``doc`` is the first document of a state's strings."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.size, self.doc = [-1], [0], [0]

    def _state(self, next_: dict[int, int], link: int, size: int, doc: int) -> int:
        self.next.append(next_)
        self.link.append(link)
        self.size.append(size)
        self.doc.append(doc)
        return len(self.link) - 1

    def _split(self, p: int, q: int, c: int) -> int:
        """The state for the strings of q that p's longest one leads to."""
        copy = self._state(self.next[q].copy(), self.link[q], self.size[p] + 1, self.doc[q])
        self.link[q] = copy
        next_, link = self.next, self.link
        while p != -1 and next_[p].get(c) == q:
            next_[p][c] = copy
            p = link[p]
        return copy

    def add(self, words: list[int], doc: int) -> None:
        """Documents come in order of their ids."""
        next_, link, size = self.next, self.link, self.size
        last = 0
        for c in words:
            q = next_[last].get(c)
            if q is not None:
                last = q if size[q] == size[last] + 1 else self._split(last, q, c)
                continue
            new, p = self._state({}, 0, size[last] + 1, doc), last
            while p != -1 and c not in next_[p]:
                next_[p][c] = new
                p = link[p]
            if p != -1:
                q = next_[p][c]
                link[new] = q if size[q] == size[p] + 1 else self._split(p, q, c)
            last = new

    def earliest(self, words: list[int]) -> list[int | None]:
        """By window of LENGTH words the least document that has it; None: none has."""
        next_, link, size, doc = self.next, self.link, self.size, self.doc
        out: list[int | None] = []
        at = held = 0
        for i, c in enumerate(words):
            while at and c not in next_[at]:
                at = link[at]
                held = size[at]
            if c in next_[at]:
                at = next_[at][c]
                held += 1
                while size[link[at]] >= LENGTH:
                    at = link[at]
                held = min(held, size[at])
            if i >= LENGTH - 1:
                out.append(doc[at] if held >= LENGTH else None)
        return out


def _runs(least: list[int | None]) -> list[dict]:
    """Neighbouring windows with one least document: lo, hi, doc."""
    out: list[dict] = []
    for i, d in enumerate(least):
        if out and out[-1]["doc"] == d:
            out[-1]["hi"] = i + 1
        else:
            out.append({"lo": i, "hi": i + 1, "doc": d})
    return out


_RUN = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32()), ("doc", pa.int64())]))


def earliest_documents(taken: DataFrame) -> DataFrame:
    """d1, d2 and runs (windows from lo to hi, and the least document that has them)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        earlier: list[tuple[Automaton, dict]] = []  # of the group that is still coming

        def told(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
            numbers: dict[bytes, int] = {}
            words = [[numbers.setdefault(w, len(numbers)) for w in r[6].split(b" ")] for r in rows]
            shard = Automaton()
            for i in sorted(range(len(rows)), key=lambda i: rows[i][4]):
                shard.add(words[i], rows[i][4])
            out = []
            for r, ws in zip(rows, words, strict=True):
                least = shard.earliest(ws)
                for other, known in earlier:
                    found = other.earliest([known.get(w, -1) for w in r[6].split(b" ")])
                    least = [a if b is None else min(a, b) for a, b in zip(least, found, strict=True)]
                if r[3] > 1 or any(d != r[4] for d in least):
                    out.append((r[1], r[2], [{"lo": x["lo"] + r[5], "hi": x["hi"] + r[5], "doc": x["doc"]} for x in _runs(least)]))
            earlier.append((shard, numbers))
            columns = list(zip(*out, strict=True)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), _RUN), strict=True)], ["d1", "d2", "runs"])

        held: list[tuple] = []
        size, last = 0, None
        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if last and r[:3] == last[:3] and r[5] == last[5]:
                    continue  # a repeated row of the input
                if last and last[0] != r[0] and (size >= SHARD or earlier):
                    yield from told(held)
                    held, size = [], 0
                    earlier.clear()
                elif last and size >= SHARD:
                    cut = next(i for i, x in enumerate(held) if x[0] == r[0])
                    if cut:  # the shard's last group goes on: what came before it is complete
                        yield from told(held[:cut])
                        earlier.clear()
                        held = held[cut:]
                    else:
                        yield from told(held)
                        held = []
                    size = sum(x[6].count(b" ") + 1 for x in held)
                held.append(r)
                size += r[6].count(b" ") + 1
                last = r
        if held:
            yield from told(held)

    placed = taken.repartition("key").sortWithinPartitions("key", "doc", "d1", "d2", "base")
    return placed.mapInArrow(run, "d1 bigint, d2 bigint, runs array<struct<lo:int,hi:int,doc:bigint>>")


def windows_to_remove(rows: DataFrame) -> DataFrame:
    """_u1, _u2 and stretches: struct(lo, hi) of windows that a document with a smaller id has; settled."""
    distinct = distinct_segments(rows, Words())
    release(rows.sparkSession)
    earliest = settle(earliest_documents(contents(rows, distinct, Words())), "earliest")
    discard(distinct)
    release(rows.sparkSession)
    every = found_segments(rows, Words(), False).select("_u1", "_u2", "start", "d1", "d2")
    met = every.join(earliest, ["d1", "d2"])
    stretch = F.transform(F.filter("runs", lambda x: x["doc"] < F.col("_u1")), lambda x: F.struct((x["lo"] + F.col("start")).alias("lo"), (x["hi"] + F.col("start")).alias("hi")))
    met = met.select("_u1", "_u2", stretch.alias("s")).where(F.size("s") > 0)
    # A set: rows that repeat id and text find the same stretches.
    out = settle(met.groupBy("_u1", "_u2").agg(F.flatten(F.collect_set("s")).alias("stretches")), "stretches")
    discard(earliest)
    release(rows.sparkSession)
    return out


def keep_words(text: bytes, stretches: list[dict] | None) -> tuple[list[bytes], int]:
    """(words kept, words in all)."""
    words = text.split()
    if not stretches:
        return words, len(words)
    edge = np.zeros(len(words) + 1, "i4")
    for s in stretches:
        edge[s["lo"]] += 1
        edge[s["hi"] - 1 + LENGTH] -= 1
    gone = np.cumsum(edge[:-1]) > 0
    return [words[i] for i in np.flatnonzero(~gone).tolist()], len(words)


def report(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_words, n_removed and kept_sha256.

    A null text has no words. A null id counts as smaller than all others; ids that aren't whole numbers are an
    error. Rows that share an id, repeated ones too, are no references for each other. An empty table gives an empty result; other columns play no part.
    """
    keys = keys_of(docs, id_col, text_col)
    stretches = windows_to_remove(docs.select(*keys))
    joined = docs.select(*keys, F.col(id_col).alias("_id")).join(stretches, ["_u1", "_u2"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, text, some in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                kept, n = keep_words(text, some)
                out.append((i, n, n - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
            types = (batch.schema.types[0], pa.int64(), pa.int64(), pa.string())
            columns = list(zip(*out, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], [id_col, "n_words", "n_removed", "kept_sha256"])

    kind = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, n_words bigint, n_removed bigint, kept_sha256 string"
    return joined.select("_id", "_bytes", "stretches").mapInArrow(run, kind)
