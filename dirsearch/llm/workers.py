"""What a Python worker keeps between tasks: Spark gives a worker tasks of one operator after another."""

from __future__ import annotations

import gc
from collections.abc import Callable

import pyarrow as pa

_KEPT: list[Callable[[], None]] = []


def kept(release: Callable[[], None]) -> None:
    """Names how to drop what an operator keeps in this worker."""
    _KEPT.append(release)


def release() -> None:
    """Drops what earlier operators kept, for an operator that needs the memory."""
    if _KEPT:
        for drop in _KEPT:
            drop()
        _KEPT.clear()
        gc.collect()
    pa.default_memory_pool().release_unused()
