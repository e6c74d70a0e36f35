"""Memory of Python workers, which outlive their tasks."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import pyarrow as pa

#: The C library's call that gives freed memory back, where there is one (glibc); numpy's arrays and Python's lists lie there.
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", lambda kept: 0)


def emptied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same batches. After each, and at the end, what a Python worker has freed goes back to the system: workers outlive
    their tasks, and would keep the most that one of them took beside the stages that follow."""
    for batch in batches:
        yield batch
        del batch
        give_back()
    give_back()


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    _TRIM(0)
