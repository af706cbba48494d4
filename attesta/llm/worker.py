"""What a Python worker keeps between tasks: one operator's memo at a time, and no memory that Arrow has done with."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa

_kept: dict = {}


def keep(key: tuple, build: Callable):
    """The memo of ``key``, built once; another operator's memo is let go first."""
    if key not in _kept:
        release()
        _kept[key] = build()
    return _kept[key]


def release() -> None:
    """Lets go of any memo: called by operators that keep none, so that memos do not add up in a worker."""
    _kept.clear()
    pa.default_memory_pool().release_unused()
