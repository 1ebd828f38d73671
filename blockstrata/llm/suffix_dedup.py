"""Suffix-array deduplication of byte strings that occur more than once.

Windows of LENGTH bytes are brought together by anchors (see passages): a shard of the suffix array is the
segments of a range of anchors, so equal windows are in one shard unless their group is larger than a shard.
A segment that occurs many times is in it once, with its number of occurrences. In each shard, suffixes are
sorted by Larsson-Sadakane refinement: groups of equal prefixes are split by the rank of what follows, and
the prefix doubles. Common prefixes of neighbours come from Kasai's rule: along a stretch of text where the
left neighbours move on by one as well, the common prefix shrinks by one until it is empty. Windows whose neighbours share
LENGTH bytes or more are repeated if they stand for two occurrences or more. A group that fills several shards
is merged across them by binary search of each one's windows in the others.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blockstrata.llm.passage_tables import contents, distinct_segments, found_segments, keys_of
from blockstrata.llm.passages import Segments, digests, segments
from blockstrata.llm.store import discard, release, settle
from blockstrata.llm.workers import tidy

LENGTH, ANCHOR = 200, 32
#: Bytes that a task sorts at once.
SHARD = 1 << 18


# -- a shard -----------------------------------------------------------------------------------------------------


def suffix_array(sym: np.ndarray, left: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffixes in order of their first ``depth`` symbols, ties by place; words of seven symbols).

    ``left``: symbols up to the next separator. Suffixes that end before a prefix is full are put last in
    their group and refined no more.
    """
    n, h = len(sym), 7
    padded = np.concatenate([sym.astype("u8"), np.full(h, 257, "u8")])
    word = np.zeros(n, "u8")
    for j in range(h):
        word = (word << np.uint64(9)) | padded[j : j + n]
    sa = np.argsort(word).astype("i4")
    rank = np.empty(n, "i4")
    sorted_, place = word[sa], np.arange(n, dtype="i4")
    head = np.concatenate([[True], sorted_[1:] != sorted_[:-1]])
    rank[sa] = np.maximum.accumulate(np.where(head, place, 0))
    width = np.uint64(max(n.bit_length(), 1))
    if 3 * int(width) > 64:
        raise ValueError("a shard is larger than what a sort key can hold")
    low = (np.uint64(1) << width) - np.uint64(1)
    left = np.minimum(left, depth).astype("u1" if depth < 256 else "i4")  # small, as it is read all over
    while h < depth:
        step = min(h, depth - h)
        slots = np.flatnonzero(~(head & np.concatenate([head[1:], [True]]))).astype("i4")
        own = sa[slots]
        room = left[own]
        alive = room >= h  # a group is alive as a whole or not at all
        slots, own, room = slots[alive], own[alive], room[alive]
        if not len(own):
            break
        after = rank[np.minimum(own + step, n - 1)]
        after[room < h + step] = n
        # Group, rank of what follows, place: sorted as one number, ties by place.
        key = rank[own].astype("u8")
        key <<= width
        key |= after.view("u4")
        key <<= width
        key |= own.view("u4")
        key.sort()
        own = (key & low).astype("i4")
        key >>= width
        sa[slots] = own
        new = np.concatenate([[True], key[1:] != key[:-1]])
        head[slots] = new
        rank[own] = np.maximum.accumulate(np.where(new, slots, 0))
        h += step
    return sa.astype("i8"), word


def common_prefixes(sa: np.ndarray, word: np.ndarray, sym: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Common prefix of each suffix in ``sa`` with the one before it, within their segments."""
    n, sa = len(sym), sa.astype("i4")
    before = np.full(n, -1, "i4")
    before[sa[1:]] = sa[:-1]
    head = np.ones(n, bool)
    # The rule holds only where the common prefix before was not empty.
    head[1:] = (before[1:] != before[:-1] + 1) | (before[:-1] < 0) | (left[:-1] == 0) | (sym[:-1] != sym[before[:-1]])
    p = np.flatnonzero(head & (before >= 0)).astype("i4")
    q, size = before[p], np.zeros(len(p), "i4")
    most = np.minimum(left[p], left[q]).astype("i4")
    # Most differ in their first word.
    size[word[p] == word[q]] = 7
    np.minimum(size, most, out=size)
    live = np.flatnonzero((size == 7) & (size < most))
    while len(live):
        a, b = p[live] + size[live], q[live] + size[live]
        same = (word[np.minimum(a, n - 1)] == word[np.minimum(b, n - 1)]) & (size[live] < most[live])
        size[live[same]] += 7
        live = live[same]
    live = np.flatnonzero(size < most)
    for _ in range(7):
        a, b = p[live] + size[live], q[live] + size[live]
        live = live[(sym[a] == sym[b]) & (size[live] < most[live])]
        size[live] += 1
        live = live[size[live] < most[live]]
    place = np.arange(n, dtype="i4")
    at_head = np.zeros(n, "i4")
    at_head[p] = np.minimum(size, most)
    chain = np.maximum.accumulate(np.where(head, place, 0))
    plcp = np.maximum(at_head[chain] - (place - chain), 0)
    plcp[before < 0] = 0
    return plcp[sa]


class Shard:
    """Segments with their numbers of occurrences; ``seen`` flags windows known to be repeated."""

    def __init__(self, texts: list[bytes], counts: list[int], depth: int = LENGTH):
        sizes = np.array([len(t) for t in texts], "i8")
        self.starts = np.concatenate([[0], np.cumsum(sizes + 1)])[:-1]
        self.sizes, self.depth = sizes, depth
        n = int(sizes.sum()) + len(texts)
        sym = np.full(n, 256, "u2")
        owner = np.repeat(np.arange(len(texts)), sizes + 1)
        left = self.starts[owner] + sizes[owner] - np.arange(n)
        sym[left > 0] = np.frombuffer(b"".join(texts), "u1")
        self.sym = sym
        sa, word = suffix_array(sym, left, depth)
        lcp = common_prefixes(sa, word, sym, left)
        valid = left[sa] >= depth
        sa, lcp = sa[valid], lcp[valid]
        run = np.cumsum(lcp < depth) - 1
        weight = np.bincount(run, np.array(counts, "f8")[owner[sa]], run[-1] + 1 if len(run) else 0)
        self.seen = np.zeros(n, bool)
        self.seen[sa[weight[run] >= 2]] = True
        self.sa, self.first = sa, np.flatnonzero(lcp < depth)

    def rows(self, places: np.ndarray) -> np.ndarray:
        return np.lib.stride_tricks.sliding_window_view(self.sym, self.depth)[places]

    def meet(self, other: Shard) -> None:
        """Marks windows that both shards hold: binary search of one's distinct windows in the other's."""
        mine, theirs = self.sa[self.first], other.sa[other.first]
        for at in range(0, len(mine), 4096):
            own = mine[at : at + 4096]
            want, lo, hi = self.rows(own), np.zeros(len(own), "i8"), np.full(len(own), len(theirs))
            while (lo < hi).any():
                mid = np.minimum((lo + hi) // 2, len(theirs) - 1)
                got = other.rows(theirs[mid])
                differs = got != want
                col = differs.argmax(1)
                r = np.arange(len(own))
                less = differs[r, col] & (got[r, col] < want[r, col])
                open_ = lo < hi
                lo, hi = np.where(open_ & less, mid + 1, lo), np.where(open_ & ~less, mid, hi)
            there = lo < len(theirs)
            there[there] = (other.rows(theirs[lo[there]]) == want[there]).all(1)
            self._mark(at + np.flatnonzero(there))
            other._mark(lo[there])

    def _mark(self, groups: np.ndarray) -> None:
        run = np.zeros(len(self.first), bool)
        run[groups] = True
        sizes = np.diff(self.first, append=len(self.sa))
        self.seen[self.sa[np.repeat(run, sizes)]] = True

    def covered(self) -> list[list[int]]:
        """Per segment: from, to, from, to ... of the bytes that repeated windows cover, merged. A segment's last
        window starts a whole window before the next segment, so stretches never cross."""
        windows = np.flatnonzero(self.seen)
        out: list[list[int]] = [[] for _ in self.starts]
        if not len(windows):
            return out
        gap = np.flatnonzero(np.diff(windows) > self.depth)
        lo, hi = np.concatenate([windows[:1], windows[gap + 1]]), np.concatenate([windows[gap], windows[-1:]]) + self.depth
        owner = np.searchsorted(self.starts, lo, side="right") - 1
        base = self.starts[owner]
        for k, x, y in zip(owner.tolist(), (lo - base).tolist(), (hi - base).tolist(), strict=True):
            out[k] += (x, y)
        return out


class Bytes:
    """Bytes as units of passages."""

    length, anchor = LENGTH, ANCHOR

    def cut(self, text: bytes, size: int) -> Iterator[tuple[int, bytes]]:
        for at in range(0, max(len(text) - LENGTH + 1, 1), size):
            yield at, text[at : at + size + LENGTH - 1]

    def segments(self, texts: list[bytes]) -> tuple[Segments, np.ndarray]:
        starts, joined = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype("i8"), b"".join(texts)
        found = segments(np.frombuffer(joined, "u1").astype("u8"), starts, LENGTH, ANCHOR)
        lo = starts[found.doc] + found.first
        return found, digests(joined, lo, lo + found.windows + LENGTH - 1)

    def sequence(self, text: bytes) -> bytes:
        return text

    def pack(self, part: bytes) -> bytes:
        return part


_RANGES = "d1 bigint, d2 bigint, ranges array<int>"


def repeated_ranges(taken: DataFrame) -> DataFrame:
    """d1, d2 and the stretches of that segment that are repeated, as from, to, from, to ..."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(shards: list[tuple[list[tuple], Shard]]) -> Iterator[pa.RecordBatch]:
            for rows, shard in shards:
                out = [(r[1], r[2], [r[5] + x for x in c]) for r, c in zip(rows, shard.covered(), strict=True) if c]
                columns = list(zip(*out, strict=True)) or [[], [], []]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.list_(pa.int32())), strict=True)], ["d1", "d2", "ranges"])

        def made(rows: list[tuple]) -> tuple[list[tuple], Shard]:
            return rows, Shard([r[6] for r in rows], [r[3] for r in rows])

        held: list[tuple] = []  # rows of the shard to be
        size, last, open_ = 0, None, []  # open_: full shards of the group that is still coming
        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if last and r[:3] == last[:3] and r[5] == last[5]:
                    continue  # a repeated row of the input
                if last and size >= SHARD:
                    if last[0] == r[0] and held[0][0] == r[0]:
                        open_.append(made(held))
                        held, size = [], 0
                    elif last[0] != r[0]:
                        yield from told(_merged([*open_, made(held)]))
                        held, size, open_ = [], 0, []
                    else:  # the shard's last group goes on: what came before it is complete
                        cut = next(i for i, x in enumerate(held) if x[0] == r[0])
                        yield from told([made(held[:cut])])
                        held = held[cut:]
                        size = sum(len(x[6]) for x in held)
                elif open_ and last[0] != r[0]:
                    yield from told(_merged([*open_, made(held)] if held else open_))
                    held, size, open_ = [], 0, []
                held.append(r)
                size += len(r[6])
                last = r
        if held:
            open_.append(made(held))
        yield from told(_merged(open_))
        tidy()

    placed = taken.repartition("key").sortWithinPartitions("key", "d1", "d2", "base")
    return placed.mapInArrow(run, _RANGES)


def _merged(shards: list) -> list:
    for i, (_, a) in enumerate(shards):
        for _, b in shards[:i]:
            a.meet(b)
    return shards


def ranges_by_document(rows: DataFrame) -> DataFrame:
    """_u1, _u2 and ranges (from, to) of repeated bytes, unmerged; settled."""
    distinct = distinct_segments(rows, Bytes())
    release(rows.sparkSession)
    ranges = settle(repeated_ranges(contents(rows, distinct, Bytes())), "ranges")
    discard(distinct)
    release(rows.sparkSession)
    every = found_segments(rows, Bytes(), False).select("_u1", "_u2", "start", "d1", "d2")
    met = every.join(ranges, ["d1", "d2"]).select("_u1", "_u2", F.transform("ranges", lambda x: x + F.col("start")).alias("r"))
    # A set: rows that repeat id and text find the same stretches.
    out = settle(met.groupBy("_u1", "_u2").agg(F.flatten(F.collect_set("r")).alias("ranges")), "stretches")
    discard(ranges)
    release(rows.sparkSession)
    return out


def cut(text: bytes, ranges: list[int] | None) -> tuple[bytes, int, int]:
    """(what is left, bytes removed, runs removed)."""
    if not ranges:
        return text, 0, 0
    pairs = np.array(ranges, "i8").reshape(-1, 2)
    pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
    upto = np.maximum.accumulate(pairs[:, 1])
    first = np.flatnonzero(np.concatenate([[True], pairs[1:, 0] > upto[:-1]]))
    lo, hi = pairs[first, 0].tolist(), upto[np.append(first[1:], len(upto)) - 1].tolist()
    left = b"".join([text[a:b] for a, b in zip([0, *hi], [*lo, len(text)], strict=True)])
    return left, len(text) - len(left), len(first)


def _joined(docs: DataFrame, id_col: str, text_col: str, carried: Column) -> DataFrame:
    keys = keys_of(docs, id_col, text_col)
    stretches = ranges_by_document(docs.select(*keys))
    return docs.select(*keys, carried).join(stretches, ["_u1", "_u2"], "left")


def report(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_bytes, n_removed, n_spans and kept_sha256.

    A null text is an empty one: nothing to remove. A row that repeats another one's id and text is a copy of
    it, so both lose what is long enough; rows with null ids are told apart by their texts. Ids that aren't whole
    numbers are an error. An empty table gives an empty result; other columns play no part.
    """
    joined = _joined(docs, id_col, text_col, F.col(id_col).alias("_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, text, ranges in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                left, removed, spans = cut(text, ranges)
                out.append((i, len(text), removed, spans, hashlib.sha256(left).hexdigest()))
            types = (batch.schema.types[0], pa.int64(), pa.int64(), pa.int64(), pa.string())
            columns = list(zip(*out, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], [id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    kind = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"
    return joined.select("_id", "_bytes", "ranges").mapInArrow(run, kind)


def clean(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with repeated bytes cut from the texts; parts of a character at a cut go too. Rows all stay, also
    those without any text left. ``size_col``, if there is one, becomes the new length.

    A null text stays null. Null ids, repeated rows, other ids and empty tables are as in report(); all other columns
    are carried along, whatever their names."""
    joined = _joined(docs, id_col, text_col, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))

    def run(texts: pa.Array, ranges: pa.Array) -> pa.Array:
        return pa.array([cut(t, r)[0].decode("utf-8", "ignore") for t, r in zip(texts.to_pylist(), ranges.to_pylist(), strict=True)], pa.string())

    left = F.arrow_udf(run, "string")(F.col("_bytes"), F.col("ranges"))
    text = F.when(F.col("ranges").isNull(), F.col(f"_row.`{text_col}`")).otherwise(left)
    out = joined.select("_row", text.alias("_text"))
    new = {text_col: F.col("_text")} | ({size_col: F.length("_text").cast(docs.schema[size_col].dataType)} if size_col in docs.columns else {})
    return out.select(*[new.get(c, F.col(f"_row.`{c}`")).alias(c) for c in docs.columns])
