"""Tables of segments that may hold repeated passages (see passages), for any kind of unit."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, NullType

from blockstrata.llm.passages import Segments
from blockstrata.llm.store import settle
from blockstrata.llm.workers import tidy

#: Bytes that a task hashes at once, and of a text that is longer.
CHUNK, PIECE = 1 << 17, 1 << 20
#: An anchor with more distinct segments than this is split by what surrounds it: FINE windows at a time.
CROWD, FINE = 4096, 8


def chunks(texts: list[bytes], kind) -> Iterator[tuple[np.ndarray, np.ndarray, list[bytes]]]:
    """(number of the text, units before the part, part) of about CHUNK bytes together. Long texts come in parts that
    share a window less a unit, so a part's windows are those that no other part has."""
    held: list[tuple[int, int, bytes]] = []
    size = 0
    for i, t in enumerate(texts):
        for before, part in kind.cut(t, PIECE) if len(t) > PIECE else [(0, t)]:
            held.append((i, before, part))
            size += len(part)
            if size >= CHUNK:
                yield _columns(held)
                held, size = [], 0
    if held:
        yield _columns(held)


def _columns(held: list[tuple[int, int, bytes]]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    number, before, part = zip(*held, strict=True)
    return np.array(number, "i8"), np.array(before, "i8"), list(part)


def keys_of(docs: DataFrame, id_col: str, text_col: str) -> list[Column]:
    """_u1, _u2 and _bytes: id and text digest tell rows apart, but for those that repeat both. Ids are whole numbers."""
    kind = docs.schema[id_col].dataType
    if not isinstance(kind, IntegralType | NullType):
        raise TypeError(f"{id_col} is {kind.simpleString()}: ids are whole numbers")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    return [F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))).alias("_u1"), F.xxhash64(text).alias("_u2"), text.alias("_bytes")]


_FOUND = "_u1 bigint, _u2 bigint, start int, windows int, anchor_at int, anchor bigint, d1 bigint, d2 bigint, n bigint"


def found_segments(rows: DataFrame, kind, combine: bool) -> DataFrame:
    """A row per segment; with ``combine``, equal segments of a batch are one row with their number and least place.
    Segments are equal if their digests d1, d2 (128 bits of BLAKE2b of the content) are.

    ``kind`` knows the units: length, cut(), segments(), sequence() and pack().
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u1, u2 = (batch.column(i).to_numpy() for i in (0, 1))
            got: list[list[np.ndarray]] = []
            for number, before, parts in chunks(batch.column(2).to_pylist(), kind):
                s, d = kind.segments(parts)
                got.append([number[s.doc], s.first + before[s.doc], s.windows, s.anchor_at, s.anchor, *d.T])
            doc, *rest = (np.concatenate(c) for c in zip(*got, strict=True)) if got else [np.zeros(0, "i8")] * 7
            n = np.ones(len(doc), "i8")
            if combine and len(doc):
                order = np.lexsort((rest[0], u1[doc], rest[5], rest[4]))
                doc, rest = doc[order], [c[order] for c in rest]
                first = np.flatnonzero(np.concatenate([[True], (rest[4][1:] != rest[4][:-1]) | (rest[5][1:] != rest[5][:-1])]))
                n = np.diff(first, append=len(doc))
                doc, rest = doc[first], [c[first] for c in rest]
            start, windows, at, anchor, d1, d2 = rest
            columns = [u1[doc], u2[doc], start.astype("i4"), windows.astype("i4"), at.astype("i4"), anchor.view("i8"), d1, d2, n]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], [x.split()[0] for x in _FOUND.split(", ")])
        tidy()

    return rows.mapInArrow(run, _FOUND)


def distinct_segments(rows: DataFrame, kind) -> DataFrame:
    """Segments whose anchor occurs twice or more, each once: anchor, d1, d2, n, crowd and its least place; settled.

    Segments are combined within batches before the one shuffle, which is by anchor for both sums.
    """
    place = F.struct("_u1", "_u2", "start", "windows", "anchor_at")
    per = found_segments(rows, kind, True).repartition("anchor").groupBy("anchor", "d1", "d2").agg(F.sum("n").alias("n"), F.min(place).alias("at"))
    of = Window.partitionBy("anchor")
    per = per.withColumn("_total", F.sum("n").over(of)).withColumn("crowd", F.count("*").over(of) > CROWD).where("_total > 1")
    return settle(per.select("anchor", "d1", "d2", "n", "crowd", "at.*"), "segments")


_TAKEN = "key bigint, d1 bigint, d2 bigint, n bigint, doc bigint, base int, content binary"


def contents(rows: DataFrame, distinct: DataFrame, kind) -> DataFrame:
    """The units of distinct segments, packed, keyed by anchor; segments of a crowded anchor in parts of FINE windows,
    keyed by what all windows of a part have in common."""
    lists = distinct.groupBy("_u1", "_u2").agg(F.collect_list(F.struct("anchor", "d1", "d2", "n", "crowd", "start", "windows", "anchor_at")).alias("_own"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                out = []
                for doc, digest, text, own in zip(*(c.to_pylist() for c in batch.slice(at, 256).columns), strict=True):
                    if last == (doc, digest):
                        continue  # a row that repeats id and text
                    last = doc, digest
                    units = kind.sequence(text)
                    for s in own:
                        out += list(_parts(doc, units, s, kind))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _TYPES, strict=True)], [x.split()[0] for x in _TAKEN.split(", ")])

    return rows.join(lists, ["_u1", "_u2"]).select("_u1", "_u2", "_bytes", "_own").mapInArrow(run, _TAKEN)


_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]


def _parts(doc: int, units, s: dict, kind) -> Iterator[tuple]:
    lo, windows, length = s["start"], s["windows"], kind.length
    if not s["crowd"]:
        yield s["anchor"], s["d1"], s["d2"], s["n"], doc, 0, kind.pack(units[lo : lo + windows + length - 1])
        return
    anchor, first = lo + s["anchor_at"], 0
    while first < windows:
        ahead = anchor - (lo + first)  # how far the anchor is from this window's start
        low = ahead // FINE * FINE
        last = min(windows - 1, anchor - low - lo)
        common = kind.pack(units[anchor - low : anchor - (low + FINE - 1) + length])
        key = int.from_bytes(hashlib.blake2b(common + low.to_bytes(4), digest_size=8).digest(), signed=True)
        yield key, s["d1"], s["d2"], s["n"], doc, first, kind.pack(units[lo + first : lo + last + length])
        first = last + 1
