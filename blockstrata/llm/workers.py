"""Good manners of Python workers: they outlive a task and share an executor's memory with the JVM."""

from __future__ import annotations

import ctypes
import gc

import pyarrow as pa


def tidy() -> None:
    """Give memory back at a task's end instead of keeping it for the next one."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)
