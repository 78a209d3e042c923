"""Memory of Python workers, which live on between tasks."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa

Scan = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def release() -> None:
    """Gives what is free back to the system, as far as the allocators can."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass


class lean:  # noqa: N801
    """f for mapInArrow, which releases its memory when a task ends: idle workers count against an executor too."""

    def __init__(self, f: Scan):
        self.f = f

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from self.f(batches)
        finally:
            release()
