"""Parts of texts that a tokenizer treats on their own: distinct parts of a batch are encoded once.

A unit's code is what ``encode`` gives for it: little-endian int32 values, or several such.  A worker keeps the codes that it used
lately: at most twice ``MOST``, in two generations, of which the older one goes when the younger is full (a matter of
speed only).  Units are told apart by their bytes.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa

MOST = 120_000


class Encoded:
    """Codes of units, encoded when first seen."""

    def __init__(self, encode: Callable[[list[str]], list], most: int = MOST):
        self.encode, self.most, self.young, self.old = encode, most, {}, {}

    def codes(self, units: list[bytes]) -> list:
        found = list(map(self.young.get, units))
        aged = [i for i, c in enumerate(found) if c is None]
        kept = list(map(self.old.get, [units[i] for i in aged]))
        new = [i for i, c in zip(aged, kept) if c is None]
        for i, c in zip(aged, kept):
            found[i] = c
        for i, c in zip(new, self.encode([units[i].decode("utf-8", "replace") for i in new]) if new else []):
            found[i] = c
        if len(self.young) + len(aged) > self.most:
            self.old, self.young = self.young, {}
        self.young.update([(units[i], found[i]) for i in aged])
        return found


def distinct(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """For non-empty spans of buf that do not overlap, in order: the number of each one's unit, and the distinct units."""
    n = len(starts)
    if n == 0:
        return np.zeros(0, np.int64), []
    mark = np.zeros(len(buf) + 1, np.int8)
    mark[ends] = -1
    mark[starts] += 1  # a span may begin where another ends
    inside = np.cumsum(mark[:-1], dtype=np.int8).view(bool)
    offsets = np.zeros(n + 1, np.int64)
    np.cumsum(ends - starts, out=offsets[1:])
    spans = pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(buf[inside])])
    coded = spans.dictionary_encode()
    return coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_pylist()


def spread(codes: list[bytes], which: np.ndarray, width: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """The values of the units ``which``, one after the other, as rows of ``width``; and how many rows each has."""
    sizes = np.fromiter(map(len, codes), np.int64, len(codes)) // (4 * width)
    values = np.frombuffer(b"".join(codes), "<i4").reshape(-1, width)
    count = sizes[which]
    first = (np.cumsum(sizes) - sizes)[which]
    total = np.cumsum(count)
    at = np.arange(total[-1] if len(total) else 0) + np.repeat(first - total + count, count)
    return values[at], count


def per_row(count: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """Sums of count by row."""
    return np.bincount(row, weights=count, minlength=n).astype(np.int64)
