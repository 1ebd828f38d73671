"""SentencePiece encoding and decoding with a batched Viterbi pass.

Units of a text (a word with the blanks before it) that weren't met before are encoded together: units of
equal length form a matrix of characters, and all rows advance a character at a time. A substring's hash is
looked up in the sorted hashes of the pieces; vectorised maxima over the piece's length keep the best score
and a backpointer for every row.

In a model of the unigram kind any path is open, and the best sum of the pieces' scores wins. In a model of the
merge kind, a piece may follow another only if merging the two pieces' characters gives just these two. Merges
depend on nothing else, so a path in which all neighbours agree is the one that merging the whole unit gives; a
step between others scores minus infinity. The result equals the reference encoder's. As no two paths agree, a
row has its maximum as soon as one step to a character is finite, and leaves that character's search.
"""

from __future__ import annotations

import hashlib
import math
import re
import sys
from collections.abc import Iterator
from itertools import chain
from types import ModuleType

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockstrata.llm.workers import tidy

BLANK = "▁"
_UNIT = re.compile(f"{BLANK}*[^{BLANK}]+|{BLANK}+")
_BASE = np.uint64(0x9E3779B97F4A7C15)
#: Units that a worker remembers, slots for pairs of pieces, rows of one matrix. Longer units, which few share a length
#: with, are probed for all characters at once instead of for all rows.
MEMORY, SLOTS, ROWS, LONG = 200_000, 1 << 20, 8192, 200


class Pieces:
    """What encoding needs of a model; small (its vocabulary), so it travels with the tasks."""

    def __init__(self, names: list[str], scores: list[float], byte_ids: dict[int, int], normal: list[bool], merges: bool = True):
        self.names, self.byte_ids, self.merges, self.scores = names, byte_ids, merges, np.array(scores, "f8")
        self.rank = {x: (-scores[i], i) for i, x in enumerate(names) if normal[i]}
        self.longest = max(map(len, self.rank))
        self.single = {x for x in self.rank if len(x) == 1}
        if any(c not in self.single for x in self.rank for c in x):
            raise ValueError("a piece has a character that is no piece")
        if any(BLANK in x.lstrip(BLANK) for x in self.rank):
            raise ValueError("a piece crosses a word's start")
        self.pairs = {a + b for x in self.rank for a, b in zip(x, x[1:], strict=False)}
        self.surface = [x.replace(BLANK, " ").encode() for x in names]
        for byte, i in byte_ids.items():
            self.surface[i] = bytes([byte])
        whole = [x for x in self.rank if not merges or self.merge(x) == [x]]
        hashes = np.array([self._hash(x) for x in whole], "u8")
        order = np.argsort(hashes)
        self.keys, self.ids = hashes[order], np.array([self.rank[x][1] for x in whole], "i8")[order]
        if (self.keys[1:] == self.keys[:-1]).any():
            raise ValueError("two pieces share a hash")
        self.bitmap = np.zeros(1 << 20, bool)
        self.bitmap[self.keys >> np.uint64(44)] = True
        self.powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(self.longest, _BASE)]).astype("u8"))
        self.known: dict[str, tuple[int, ...]] = {}
        self.slot_code, self.slot_agrees = np.full(SLOTS, -1, "i8"), np.zeros(SLOTS, bool)

    def _hash(self, text: str) -> int:
        h = 0
        for c in text:
            h = (h * int(_BASE) + ord(c) + 1) & (2**64 - 1)
        return h

    def merge(self, text: str) -> list[str]:
        """Merging by rank, leftmost first, for short texts: defines which pieces agree."""
        parts = list(text)
        while len(parts) > 1:
            found = [(self.rank[a + b][0], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in self.rank]
            if not found:
                break
            i = min(found)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def _agrees(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether piece b may follow piece a, for arrays; a = -1 is a start. Pairs met before are in slots by hash."""
        if not self.merges:
            return np.ones(len(b), bool)
        codes = (a + 1) * len(self.names) + b
        slot = ((codes.astype("u8") * _BASE) >> np.uint64(64 - (SLOTS.bit_length() - 1))).astype("i8")
        new = np.flatnonzero(self.slot_code[slot] != codes)
        out = self.slot_agrees[slot]
        if len(new):
            some, at = np.unique(codes[new], return_inverse=True)
            got = np.array([self._pair(c) for c in some.tolist()], bool)
            out[new] = got[at]
            self.slot_code[slot[new]], self.slot_agrees[slot[new]] = codes[new], out[new]
        return out

    def _pair(self, code: int) -> bool:
        a, b = divmod(code, len(self.names))
        return a == 0 or self.merge(self.names[a - 1] + self.names[b]) == [self.names[a - 1], self.names[b]]

    def _lookup(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places whose hash is a piece's, ids). A bitmap of the hashes' top bits spares most searches."""
        some = np.flatnonzero(self.bitmap[hashes >> np.uint64(44)])
        hashes = hashes[some]
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        hit = self.keys[at] == hashes
        return some[hit], self.ids[at[hit]]

    def viterbi(self, units: list[str]) -> list[tuple[int, ...]]:
        """Ids of units of one length; all their characters are pieces."""
        m, n = len(units), len(units[0])
        chars = np.frombuffer("".join(units).encode("utf-32-le"), "<u4").reshape(m, n).astype("u8").T + np.uint64(1)
        prefix = np.zeros((n + 1, m), "u8")
        for j in range(n):
            prefix[j + 1] = prefix[j] * _BASE + chars[j]
        score = np.full((n + 1, m), -np.inf)
        score[0] = 0
        piece, back = np.full((n + 1, m), -1, "i4"), np.zeros((n + 1, m), "i4")
        for j in range(1, n + 1):
            rest, here = np.arange(m), prefix[j]
            for size in range(min(self.longest, j), 0, -1):
                own, ids = self._lookup(here - prefix[j - size][rest] * self.powers[size])
                if not len(own):
                    continue
                rows = rest[own]
                step = np.where(self._agrees(piece[j - size][rows], ids), score[j - size][rows] + self.scores[ids], -np.inf)
                better = step > score[j][rows]
                rows = rows[better]
                score[j][rows], piece[j][rows], back[j][rows] = step[better], ids[better], size
                if self.merges:
                    open_ = score[j][rest] == -np.inf
                    rest, here = rest[open_], here[open_]
                    if not len(rest):
                        break
        at, path, r = np.full(m, n), [], np.arange(m)
        while at.any():
            path.append(np.where(at > 0, piece[at, r], -1))
            at = at - back[at, r]
        return [tuple(x[k:]) if (k := x.count(-1)) else tuple(x) for x in np.stack(path[::-1], 1).tolist()]

    def _long(self, unit: str) -> tuple[int, ...]:
        """The same for one unit of any length: each size's substrings are probed together, and maxima follow from the hits."""
        n, names = len(unit), len(self.names)
        chars = np.frombuffer(unit.encode("utf-32-le"), "<u4").astype("u8") + np.uint64(1)
        hits: list[list[tuple[int, int, float]]] = [[] for _ in range(n + 1)]
        h = np.zeros(n, "u8")
        for size in range(1, min(self.longest, n) + 1):
            h = h[: n - size + 1] * _BASE + chars[size - 1 :]
            at, ids = self._lookup(h)
            for i, x, s in zip(at.tolist(), ids.tolist(), self.scores[ids].tolist(), strict=True):
                hits[i + size].append((size, x, s))
        score, piece, back, agree = [0.0] + [-math.inf] * n, [-1] * (n + 1), [0] * (n + 1), {}
        for j in range(1, n + 1):
            for size, x, s in hits[j]:
                s += score[j - size]
                if s > score[j]:
                    code = (piece[j - size] + 1) * names + x
                    if self.merges and code not in agree:
                        agree[code] = self._pair(code)
                    if not self.merges or agree[code]:
                        score[j], piece[j], back[j] = s, x, size
        j, path = n, []
        while j:
            path.append(piece[j])
            j -= back[j]
        return tuple(reversed(path))

    def runs(self, unit: str) -> Iterator[str]:
        """Stretches of a unit that no merge crosses: unknown characters alone, and pairs that no piece has part."""
        at = 0
        for i in range(1, len(unit)):
            if unit[i - 1 : i + 1] not in self.pairs:
                yield unit[at:i]
                at = i
        yield unit[at:]

    def learn(self, units: set[str]) -> dict[str, tuple[int, ...]]:
        plain = {u for u in units if len(u) <= LONG and self.single.issuperset(u)}
        split = {u: list(self.runs(u)) for u in units - plain}
        new = plain | {r for runs in split.values() for r in runs if r not in self.known}
        done = {r: tuple(self.byte_ids[b] for b in r.encode()) for r in new if len(r) == 1 and r not in self.single}
        done |= {r: self._long(r) for r in new if len(r) > LONG}
        by_size: dict[int, list[str]] = {}
        for r in new - done.keys():
            by_size.setdefault(len(r), []).append(r)
        for same in by_size.values():
            for at in range(0, len(same), ROWS):
                done.update(zip(same[at : at + ROWS], self.viterbi(same[at : at + ROWS]), strict=True))
        get = lambda r: done[r] if r in done else self.known[r]
        whole = {u: tuple(x for r in runs for x in get(r)) for u, runs in split.items()}
        done.update(whole)
        return done

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        units = [_UNIT.findall((BLANK + t).replace(" ", BLANK)) if t else [] for t in texts]
        every = set(chain.from_iterable(units))
        new = every.difference(self.known)
        if len(self.known) + len(new) > MEMORY:
            self.known = {u: self.known[u] for u in every if u in self.known}  # what is common is in any batch
        self.known.update(self.learn(new))
        get = self.known.__getitem__
        return [np.fromiter(chain.from_iterable(map(get, us)), "i4") for us in units]

    def decode(self, ids: np.ndarray) -> str:
        surface = self.surface
        return b"".join([surface[i] for i in ids.tolist()]).decode("utf-8", "replace").removeprefix(" ")


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a serialised message's fields; values of fixed width are left out."""

    def varint(at: int) -> tuple[int, int]:
        out = shift = 0
        while True:
            out, at, shift = out | (raw[at] & 127) << shift, at + 1, shift + 7
            if raw[at - 1] < 128:
                return out, at

    at = 0
    while at < len(raw):
        tag, at = varint(at)
        if tag & 7 == 0:
            value, at = varint(at)
            yield tag >> 3, value
        elif tag & 7 == 2:
            size, at = varint(at)
            yield tag >> 3, raw[at : at + size]
            at += size
        else:
            at += 8 if tag & 7 == 1 else 4


def kind_of(model: bytes) -> int:
    """1 for unigram, which is also what a model without that field is, 2 for merges: fixed by the format."""
    training = next((v for n, v in _fields(model) if n == 2), b"")
    return next((v for n, v in _fields(training) if n == 3), 1)


def load(path: str) -> dict:
    """What Pieces is made from, read by the driver: plain values, as many as the vocabulary has."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    kind = kind_of(sp.serialized_model_proto())
    if kind not in (1, 2):
        raise ValueError("the model is neither of the unigram nor of the merge kind")
    if sp.decode(sp.encode("  a  b ")) != "  a  b ":
        raise ValueError("the model's normalisation isn't the identity with a blank in front")
    n = range(sp.get_piece_size())
    names = [sp.id_to_piece(i) for i in n]
    special = [sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) for i in n]
    return {
        "names": names, "scores": [sp.get_score(i) for i in n], "byte_ids": {int(names[i][3:5], 16): i for i in n if sp.is_byte(i)},
        "normal": [not x for x in special], "merges": kind == 2,
    }


def at_worker(value) -> Pieces:
    """The model of a broadcast, made once in each worker. Pairs of pieces are remembered from task to task."""
    kept = sys.modules.setdefault("_blockstrata_worker", ModuleType("_blockstrata_worker")).__dict__
    if kept.get("made_from") is not value.value:
        kept["made_from"], kept["model"] = value.value, Pieces(**value.value)
    return kept["model"]


def _coded(docs: DataFrame, pieces: dict, text_col: str, keep: list[str], ids: bool) -> DataFrame:
    kinds = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep]
    value = docs.sparkSession.sparkContext.broadcast(pieces)  # a vocabulary: its size doesn't grow with the data

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = at_worker(value)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                texts = part.column(part.num_columns - 1).to_pylist()
                got = model.encode(texts)
                n = pa.array([len(x) for x in got], pa.int64())
                ok = pa.array([model.decode(x) == (t or "") for x, t in zip(got, texts, strict=True)])
                if ids:
                    last = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(x) for x in got])]), pa.int32()), pa.array(np.concatenate([*got, np.zeros(0, "i4")])))
                else:
                    last = pa.array([hashlib.sha256(x.astype("<i4").tobytes()).hexdigest() for x in got])
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], n, ok, last], [*keep, "n_pieces", "round_trip", "ids" if ids else "ids_sha256"])
        model.known = {}
        tidy()

    return docs.select(*keep, F.col(text_col).alias("_text")).mapInArrow(run, ", ".join([*kinds, "n_pieces bigint", "round_trip boolean", "ids array<int>" if ids else "ids_sha256 string"]))


def encode_documents(docs: DataFrame, model: str, *, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, n_pieces, round_trip (decoding gives the text again) and ids.

    A null or empty text has no pieces and comes back as an empty one. A literal U+2581 is a blank, as the format has
    it, so a text with one does not come back: round_trip says so. Characters outside the vocabulary become byte
    pieces. Repeated rows are coded alike; an empty table gives an empty result; other columns play no part.
    """
    return _coded(docs, load(model), text_col, list(keep), True)


def encode_digests(docs: DataFrame, model: str, *, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """As encode_documents(), with the SHA-256 of the ids as little-endian 32-bit numbers in their place."""
    return _coded(docs, load(model), text_col, list(keep), False)


def decode_documents(coded: DataFrame, model: str, *, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` and text from ids; null ids give a null text, no ids an empty one. Bytes that are no UTF-8 become U+FFFD.
    Repeated rows are decoded alike; an empty table gives an empty result; other columns play no part."""
    value = coded.sparkSession.sparkContext.broadcast(load(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [None if x.as_py() is None else at_worker(value).decode(np.array(x.as_py(), "i4")) for x in b.column(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(texts, pa.string())], [*keep, "text"])

    kinds = [f"`{c}` {coded.schema[c].dataType.simpleString()}" for c in keep]
    return coded.select(*keep, "ids").mapInArrow(run, ", ".join([*kinds, "text string"]))
