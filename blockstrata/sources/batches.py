"""Arrow batches in parts of bounded size."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa

#: Bytes of a part; a row may have more.
PART = 4 << 20


def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows, some PART bytes at a time. A batch has thousands of rows of any size, and what is made of the rows
    that are taken at once is held at once, several times over."""
    for batch in batches:
        n, size = batch.num_rows, batch.nbytes
        step = max(1, n * PART // max(1, size))
        for at in range(0, n, step):
            yield batch.slice(at, step)
        pa.default_memory_pool().release_unused()


def in_parts(rows: Iterable[tuple], part: int = PART) -> Iterator[list[tuple]]:
    """Rows, whose last value is their content, some ``part`` bytes at a time, as they are made."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[-1])
        if size >= part:
            yield held
            held, size = [], 0
    if held:
        yield held
