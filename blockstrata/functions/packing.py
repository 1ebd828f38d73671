"""Bit widths, palettes, packed rows, mixed radices, Morton order and coordinates as column expressions, with numpy twins
for the codecs. Rows are 64-bit; a row holds whole cells only, the first in its low bits."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def bit_width(n: Column, least: int = 0) -> Column:
    """Bits that tell n values apart: none for one value or none at all."""
    bits = F.when(n <= 1, 0).otherwise(F.length(F.bin(n.cast("long") - 1)))
    return F.greatest(bits, F.lit(least)) if least else bits


def palette(cells: Column) -> Column:
    """Distinct values in the order in which they come first."""
    return F.array_distinct(cells)


def pack(cells: Column, entries: Column, bits: Column | int) -> Column:
    """Rows of palette indices; bits must be 1 at least."""
    width = F.lit(bits) if isinstance(bits, int) else bits
    per = F.floor(F.lit(64) / width).cast("int")
    index = F.transform(cells, lambda c: F.array_position(entries, c) - 1)
    rows = F.ceil(F.size(cells) / per).cast("int")
    fold = lambda r: F.aggregate(
        F.reverse(F.slice(index, r * per + 1, per)), F.lit(0).cast("long"), lambda a, x: F.call_function("shiftleft", a, width).bitwiseOR(x)
    )
    return F.when(rows > 0, F.transform(F.sequence(F.lit(0), rows - 1), fold)).otherwise(F.array().cast("array<bigint>"))


def unpack(rows: Column, entries: Column, bits: Column | int, cells: Column | int) -> Column:
    """Values of the first ``cells`` cells; an index beyond the palette is an error."""
    width = F.lit(bits) if isinstance(bits, int) else bits
    n = F.lit(cells) if isinstance(cells, int) else cells
    per = F.floor(F.lit(64) / width).cast("int")
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), width) - 1

    def at(i: Column) -> Column:
        row = F.element_at(rows, F.floor(i / per).cast("int") + 1)
        return F.element_at(entries, F.call_function("shiftrightunsigned", row, (i % per) * width).bitwiseAND(mask).cast("int") + 1)

    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), at))


def homogeneous(cells: Column) -> Column:
    return F.forall(cells, lambda c: c.eqNullSafe(F.get(cells, F.lit(0))))


def radix_id(digits: list[Column], sizes: list[int], least: int = 0) -> Column:
    """The number of a digit vector; the last digit counts least."""
    out = F.lit(0).cast("long")
    for digit, size in zip(digits, sizes, strict=True):
        out = out * size + digit
    return out + least


def radix_digits(number: Column, sizes: list[int], least: int = 0) -> list[Column]:
    out, rest = [], number.cast("long") - least
    for size in reversed(sizes):
        out.append(F.pmod(rest, F.lit(size)))
        rest = F.floor(rest / size)
    return out[::-1]


def morton(x: Column, y: Column, bits: int = 16) -> Column:
    """Bits of x and y in turn, x lowest."""
    out = F.lit(0).cast("long")
    for b in range(bits):
        for value, place in ((x, 2 * b), (y, 2 * b + 1)):
            out = out.bitwiseOR(F.shiftleft(F.shiftright(value.cast("long"), b).bitwiseAND(F.lit(1).cast("long")), place))
    return out


def region_of(chunk: Column) -> Column:
    """Regions are 32 chunks wide, also left of zero."""
    return F.shiftright(chunk, 5)


def local_of(chunk: Column) -> Column:
    return F.pmod(chunk, F.lit(32))


def location_entry(sector: Column, sectors: Column) -> Column:
    """A region header's entry: three bytes of first sector, a byte of length."""
    return F.shiftleft(sector.cast("long"), 8).bitwiseOR(sectors.cast("long"))


def location_parts(entry: Column) -> tuple[Column, Column]:
    return F.shiftright(entry, 8), entry.bitwiseAND(F.lit(255).cast("long"))


# -- numpy twins -------------------------------------------------------------------------------------------------


def width_of(n: int, least: int = 0) -> int:
    return max(least, (n - 1).bit_length() if n > 1 else 0)


#: Widths of which bytes are made without a gap.
EVEN = (1, 2, 4, 8)


def unpack_cells(rows: np.ndarray, bits: int, cells: int) -> np.ndarray:
    """Palette indices; cells without a row are 0."""
    out = np.zeros(cells, "i8")
    if bits in EVEN:  # rows without a gap: bytes, halved as often as needed
        flat, wide = np.ascontiguousarray(rows, "<u8").view("u1"), 8
        while wide > bits:
            wide //= 2
            halves = np.empty(2 * len(flat), "u1")
            halves[::2], halves[1::2] = flat & ((1 << wide) - 1), flat >> wide
            flat = halves
    else:
        shifts = (np.arange(64 // bits) * bits).astype("u8")
        flat = ((rows.astype("u8")[:, None] >> shifts) & np.uint64((1 << bits) - 1)).ravel()
    n = min(cells, len(flat))
    out[:n] = flat[:n]
    return out


def pack_cells(index: np.ndarray, bits: int) -> np.ndarray:
    per = 64 // bits
    padded = np.zeros(-(-len(index) // per) * per, "u1" if bits in EVEN else "u8")
    padded[: len(index)] = index
    if bits in EVEN:
        while bits < 8:
            padded, bits = padded[::2] | padded[1::2] << bits, 2 * bits
        return padded.view("<u8").astype("u8", copy=False)
    return np.bitwise_or.reduce(padded.reshape(-1, per).T << (np.arange(per) * bits).astype("u8")[:, None], axis=0)


def _places(values: list[int]) -> bytes:
    out = bytearray(256)
    for i, v in enumerate(values):
        out[v] = i
    return bytes(out)


def first_seen(cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(values in order of first appearance, index of each cell)."""
    low, n = int(cells.min()) if len(cells) else 0, len(cells)
    span = int(cells.max()) - low + 1 if n else 0
    if span == 1:
        return cells[:1].copy(), np.zeros(n, "i8")
    if 0 < span <= 256:  # as bytes: found and told apart without a number a cell
        raw = (cells - low).astype("u1")
        text = raw.tobytes()
        met = list(dict.fromkeys(text)) if n <= 256 else sorted(np.flatnonzero(np.bincount(raw)).tolist(), key=text.find)
        return (np.array(met) + low).astype(cells.dtype), np.frombuffer(text.translate(_places(met)), "u1")
    if 0 < span <= 1 << 16:  # no sort: what is written to a place last stays, so cells are gone through backwards
        at = cells - low
        first = np.full(span, n)
        first[at[::-1]] = np.arange(n - 1, -1, -1)
        met = np.flatnonzero(first < n)
        met = met[np.argsort(first[met])]
        first[met] = np.arange(len(met))
        return (met + low).astype(cells.dtype), first[at]
    values, first, at = np.unique(cells, return_index=True, return_inverse=True)
    order = np.argsort(first)
    place = np.empty(len(order), "i8")
    place[order] = np.arange(len(order))
    return values[order], place[at]
