"""Where passages that occur more than once can be: windows of L units grouped by an anchor inside them.

Each window of L units (bytes or words) is assigned to the unit string of length K in it with the least hash,
the leftmost of equals. Equal windows have equal anchors at equal places. A run of neighbouring windows with
one anchor is a segment; only segments whose anchor occurs again can hold a repeated window. So a repeated
window and all its copies meet under one key, whichever documents they are in, and everything else is left
out without loss.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import numpy as np

_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0x632BE59BD9B4E019, 0xD6E8FEB86659FD93))
_INV = np.uint64(pow(int(_A), -1, 2**64))
#: Low bits of a packed value that tell a place; the chunk that is worked on at once is shorter.
PLACE = 31


class Segments(NamedTuple):
    """Columns; ``first`` counts from the start of the document ``doc``."""

    doc: np.ndarray
    first: np.ndarray
    windows: np.ndarray
    anchor_at: np.ndarray
    anchor: np.ndarray


def digests(data: bytes, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """BLAKE2b of each stretch, as two numbers: what is taken for equal content. The hashes below only choose anchors."""
    view, blake = memoryview(data), hashlib.blake2b
    made = b"".join([blake(view[a:b], digest_size=16).digest() for a, b in zip(lo.tolist(), hi.tolist(), strict=True)])
    return np.frombuffer(made, "<i8").reshape(-1, 2)


_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        size = max(n, 1 << 20)
        _powers["up"], _powers["down"] = (np.cumprod(np.concatenate([[np.uint64(1)], np.full(size, b)]).astype("u8")) for b in (_A, _INV))
    return _powers["up"][:n], _powers["down"][:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _C
    h = (h ^ (h >> np.uint64(29))) * _A
    return h ^ (h >> np.uint64(32))


def sums(units: np.ndarray) -> np.ndarray:
    """Prefix sums from which span_hash() tells the hash of any stretch."""
    up, _ = _power(len(units))
    return np.concatenate([[np.uint64(0)], np.cumsum((units + np.uint64(1)) * up)]).astype("u8")


def span_hash(prefix: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Depends on the units in [lo, hi) and their number, not on where they are; different units can share it."""
    _, down = _power(len(prefix) + 1)
    return mix((prefix[hi] - prefix[lo]) * down[lo] + _B * (hi - lo).astype("u8"))


def _places(n: int) -> np.ndarray:
    if len(_powers.get("at", ())) < n:
        _powers["at"] = np.arange(max(n, 1 << 20), dtype="u8")
    return _powers["at"][:n]


def _least(v: np.ndarray, w: int) -> np.ndarray:
    """Least of each w neighbours."""
    span = 1
    while span * 2 <= w:
        v = np.minimum(v[:-span], v[span:])
        span *= 2
    return np.minimum(v[: len(v) - (w - span)], v[w - span :]) if span < w else v


def segments(units: np.ndarray, starts: np.ndarray, length: int, k: int) -> Segments:
    """Of documents laid end to end; ``starts`` has their first units and the end."""
    n, sizes = len(units), np.diff(starts)
    if n < length or sizes.max(initial=0) < length:
        none = np.zeros(0, "i8")
        return Segments(none, none, none, none, none.astype("u8"))
    prefix = sums(units)
    _, down = _power(n + 1)
    h = mix((prefix[k:] - prefix[:-k]) * down[: n - k + 1] + np.uint64(int(_B) * k % 2**64))  # span_hash() of all strings of k units
    best = h & ~np.uint64((1 << PLACE) - 1)
    best |= _places(n - k + 1)
    anchor = (_least(best, length - k + 1).astype("u4") & np.uint32((1 << PLACE) - 1)).astype("i4")
    per = np.maximum(sizes - length + 1, 0)
    if len(sizes) == 1:
        doc, start = np.zeros(int(per[0]), "i4"), np.arange(int(per[0]), dtype="i4")
    else:  # windows that stay within a document
        doc = np.repeat(np.arange(len(sizes), dtype="i4"), per)
        start = np.arange(len(doc), dtype="i4") + np.repeat((starts[:-1] - np.cumsum(per) + per).astype("i4"), per)
        anchor = anchor[start]
    new = np.ones(len(doc), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
    head = np.flatnonzero(new)
    count = np.diff(head, append=len(doc))
    lo, doc, anchor = start[head].astype("i8"), doc[head].astype("i8"), anchor[head].astype("i8")
    return Segments(doc, lo - starts[doc], count, anchor - lo, h[anchor])
