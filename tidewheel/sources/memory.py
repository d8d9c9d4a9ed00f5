"""Memory of Python workers, which outlive their tasks."""

from __future__ import annotations

import ctypes
import gc

import pyarrow as pa


def release() -> None:
    """Give freed memory back to the system, which allocators would keep for the worker's next task."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)
