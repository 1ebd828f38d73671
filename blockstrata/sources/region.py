"""Region containers: 4 KiB of locations, 4 KiB of timestamps, then chunks in 4 KiB sectors."""

from __future__ import annotations

import gzip
import zlib
from collections.abc import Iterable, Iterator
from typing import NamedTuple

SECTOR, SIDE = 4096, 32
GZIP, ZLIB, PLAIN = 1, 2, 3


class Region(NamedTuple):
    timestamps: bytes
    chunks: list[tuple[int, int, bytes]]
    errors: list[tuple[int, int, str]]


def read_region(data: bytes, region_x: int, region_z: int) -> Region | None:
    """None for a file without a whole location table or without any chunk. Chunks whose stream is corrupt are
    left out and listed in ``errors``; an unknown compression is an error of the file."""
    errors: list[tuple[int, int, str]] = []
    chunks = list(region_chunks(data, region_x, region_z, errors))
    return Region(timestamps_of(data), chunks, errors) if chunks else None


def timestamps_of(data: bytes) -> bytes:
    return bytes(memoryview(data)[SECTOR : 2 * SECTOR])


def region_chunks(data: bytes, region_x: int, region_z: int, errors: list[tuple[int, int, str]] | None = None) -> Iterator[tuple[int, int, bytes]]:
    """x, z and content of read_region()'s chunks, one by one; nothing else of the region is held decompressed."""
    data = memoryview(data)
    if len(data) < SECTOR:
        return
    if len(data) < 2 * SECTOR:
        raise ValueError("region has no timestamps: shorter than 8192 bytes")
    for slot in range(SIDE * SIDE):
        where = int.from_bytes(data[4 * slot : 4 * slot + 4])
        if not where:
            continue
        x, z = region_x * SIDE + slot % SIDE, region_z * SIDE + slot // SIDE
        at = (where >> 8) * SECTOR
        if at + 5 > len(data):
            raise ValueError(f"chunk {x},{z} lies beyond the end of its region")
        end = at + 4 + max(int.from_bytes(data[at : at + 4]), 1)
        if end > len(data):
            raise ValueError(f"chunk {x},{z} is shorter than its stated length")
        body = data[at + 5 : end]
        kind = data[at + 4]
        try:
            if kind == ZLIB:
                raw = zlib.decompress(body)
            elif kind == GZIP:
                raw = gzip.decompress(body)
            elif kind == PLAIN:
                raw = bytes(body)
            else:
                raise ValueError(f"chunk {x},{z} has an unknown compression: {kind}")
        except (zlib.error, EOFError, OSError) as e:
            if errors is not None:
                errors.append((x, z, str(e)))
            continue
        yield x, z, raw


def write_region(region_x: int, region_z: int, timestamps: bytes, chunks: Iterable[tuple[int, int, bytes]]) -> bytes:
    """Sectors follow the order of ``chunks``; without any, the file is its two headers."""
    if len(timestamps) != SECTOR:
        raise ValueError("timestamps have 4096 bytes")
    table, body, sector = bytearray(SECTOR), [], 2
    for x, z, raw in chunks:
        lx, lz = x - region_x * SIDE, z - region_z * SIDE
        if not (0 <= lx < SIDE and 0 <= lz < SIDE):
            raise ValueError(f"chunk {x},{z} lies outside region {region_x},{region_z}")
        packed = zlib.compress(raw)
        entry = (len(packed) + 1).to_bytes(4) + bytes([ZLIB]) + packed
        n = -(-len(entry) // SECTOR)
        if n > 255:
            raise ValueError(f"chunk {x},{z} takes {n} sectors; a region's entry holds 255 at most")
        table[4 * (lx + SIDE * lz) : 4 * (lx + SIDE * lz) + 4] = (sector << 8 | n).to_bytes(4)
        body.append(entry.ljust(n * SECTOR, b"\0"))
        sector += n
    return bytes(table) + timestamps + b"".join(body)
