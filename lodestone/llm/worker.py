"""What a Python worker keeps between tasks: one operator's tables at a time, and no freed memory."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa

_held: dict[tuple, object] = {}


def held(key: tuple, make: Callable[[], object]):
    """The tables under ``key``, made where the worker doesn't hold them; other operators' tables go first."""
    if key not in _held:
        _held.clear()
        trim()
        _held[key] = make()
    return _held[key]


def trim() -> None:
    """Give freed memory back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def begin(keeps: bool) -> None:
    """A task begins: tables that its operator doesn't keep go."""
    if not keeps and _held:
        _held.clear()
        trim()


def tidy(f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], keeps: bool = False):
    """A task's function that leaves the worker as it found it; with ``keeps`` tables from ``held`` stay for the next task."""

    @wraps(f)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from lodestone.llm import worker  # the worker's module: this function travels by value

        worker.begin(keeps)
        try:
            for n, batch in enumerate(f(batches)):
                yield batch
                if n % 16 == 15:
                    worker.trim()
        finally:
            worker.trim()

    return run
