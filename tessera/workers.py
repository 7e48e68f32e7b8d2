"""Memory of Python workers, which serve task after task of one operator and then of the next.

What a worker keeps between tasks (memos, tables) belongs to one operator at a time, and what it has
freed goes back to the system when a task ends, so that a job of many operators needs no more than
its largest one.
"""

from __future__ import annotations

import ctypes
import time
from collections.abc import Callable, Iterator

import pyarrow as pa

_kept: dict[str, dict] = {}
_PAUSE = 0.25
_released = 0.0


def kept(owner: str) -> dict:
    """What ``owner`` keeps in this process; asking for it drops what any other owner kept."""
    if owner not in _kept:
        _kept.clear()
        _kept[owner] = {}
    return _kept[owner]


def release() -> None:
    """Give freed memory of Arrow's pool and of the C library back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only some C libraries have it
    if trim is not None:
        trim(0)


def _release_now_and_then() -> None:
    global _released
    if time.monotonic() - _released >= _PAUSE:
        release()
        _released = time.monotonic()


def lean(run: Callable[[Iterator], Iterator], owner: str = "") -> Callable[[Iterator], Iterator]:
    """``run`` over the batches of a task, with ``release`` at its end; an ``owner`` drops what others kept."""

    def call(batches: Iterator) -> Iterator:
        if owner:
            kept(owner)
        try:
            yield from run(batches)
        finally:
            release()

    return call


def lean_group(run: Callable[[pa.Table], pa.Table], owner: str = "") -> Callable[[pa.Table], pa.Table]:
    """``run`` over a group, with ``release`` behind it unless the last one was a moment ago."""

    def call(table: pa.Table) -> pa.Table:
        if owner:
            kept(owner)
        out = run(table)
        _release_now_and_then()
        return out

    return call


def lean_cogroup(run: Callable[[pa.Table, pa.Table], pa.Table], owner: str = "") -> Callable[[pa.Table, pa.Table], pa.Table]:
    """``run`` over two groups of one key, as ``lean_group``."""

    def call(left: pa.Table, right: pa.Table) -> pa.Table:
        if owner:
            kept(owner)
        out = run(left, right)
        _release_now_and_then()
        return out

    return call
