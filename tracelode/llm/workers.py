"""Memory of Python workers between tasks.

Workers are kept from task to task, so what one operator has cached or freed
without giving it back counts against the next.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import pyarrow as pa

_DROPS: dict[str, Callable[[], None]] = {}
_NOW = {"owner": ""}


def on_leave(owner: str, drop: Callable[[], None]) -> None:
    """``drop`` runs when a pass of another owner starts in this worker."""
    _DROPS[owner] = drop


def lean(owner: str = ""):
    """Decorator for the function given to mapInArrow: drops others' caches before, returns free memory after."""

    def wrap(run):
        @functools.wraps(run)
        def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            if _NOW["owner"] not in ("", owner):
                _DROPS.get(_NOW["owner"], lambda: None)()
            _NOW["owner"] = owner
            try:
                yield from run(batches)
            finally:
                pa.default_memory_pool().release_unused()
                try:
                    ctypes.CDLL("libc.so.6").malloc_trim(0)
                except (OSError, AttributeError):  # another C library
                    pass

        return inner

    return wrap
