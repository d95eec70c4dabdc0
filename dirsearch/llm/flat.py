"""Whole Arrow text columns as flat byte arrays: words, lines and 64-bit hashes by vector operations.

The helpers work inside ``mapInArrow`` tasks.  A column becomes one uint8 buffer with row offsets; words, lines and
their hashes are index arrays over it, so no Python object is made per word.  Rows are handled in chunks of a few
megabytes (``chunks``): memory depends on the longest single text, not on the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

# The separators of words are space and 0x09-0x0D.
SEPARATORS = b" \t\n\x0b\x0c\r"
CHUNK_BYTES = 1 << 20

_IS_SEP = np.zeros(256, bool)
_IS_SEP[list(SEPARATORS)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)  # any odd numbers would do


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (xor-shift and multiply)."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: int):
        self.base = base
        self.up = np.ones(1, np.uint64)
        self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n + n // 8, 1 << 16)
            for name, b in (("up", self.base), ("down", pow(self.base, -1, 1 << 64))):
                x = np.full(size, b, np.uint64)
                x[0] = 1
                setattr(self, name, np.multiply.accumulate(x))
        return self.up, self.down


_POWERS = tuple(_Powers(b) for b in _BASES)


def span_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, family: int = 0) -> np.ndarray:
    """64-bit hash of values[s:e] for every span; equal spans hash alike wherever they stand."""
    n = len(values)
    up, down = _POWERS[family].get(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * up[:n], out=total[1:])
    h = (total[ends] - total[starts]) * down[starts]
    return mix(h ^ ((ends - starts).astype(np.uint64) * np.uint64(0xA24BAED4963EE407)))


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) for runs of rows of about ``limit`` bytes; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if not pa.types.is_large_string(column.type) and not pa.types.is_large_binary(column.type):
        width = np.int32
    else:
        width = np.int64
    n = len(column)
    if n == 0:
        return
    bufs = column.buffers()
    offs = np.frombuffer(bufs[1], width)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(offs, offs[lo] + limit, side="right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield lo, hi, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def lower(buf: np.ndarray) -> np.ndarray:
    """A-Z to a-z, other bytes unchanged."""
    return _LOWER[buf]


def _edges(inside: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row numbers of the runs of True; runs end at row boundaries."""
    n = len(inside)
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    at = offs[:-1][offs[:-1] < n]
    first[at] = inside[at]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    at = offs[1:][(offs[1:] > 0) & (offs[1:] <= n)] - 1
    last[at] = inside[at]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(offs, starts, side="right") - 1


def words(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of the words ``[^\\x20\\x09-\\x0D]+``."""
    if len(buf) == 0:
        z = np.zeros(0, np.int64)
        return z, z, z
    return _edges(~_IS_SEP[buf], offs)


def lines(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends, rows and number within the row of the ``\\n``-split lines; empty lines are included.

    A row has one line more than it has line feeds (an empty row has one empty line).
    """
    nl = np.flatnonzero(buf == 10)
    n = len(offs) - 1
    rows = np.concatenate([np.arange(n), np.searchsorted(offs, nl, side="right") - 1])
    starts = np.concatenate([offs[:-1], nl + 1])
    ends = np.concatenate([offs[1:], nl])
    # the k-th line of a row ends at its k-th line feed, the last one at the row's end
    starts, ends = starts[np.lexsort((starts, rows))], ends[np.lexsort((ends, rows))]
    rows = np.sort(rows)
    per_row = np.bincount(rows, minlength=n)
    number = np.arange(len(rows)) - np.repeat(np.cumsum(per_row) - per_row, per_row)
    return starts, ends, rows, number


def grams(h: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the k-grams of h that lie within one row."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    g = np.zeros(n, np.uint64)
    for i in range(k):
        g = g * np.uint64(_BASES[1]) + h[i : i + n]
    at = np.flatnonzero(rows[:n] == rows[k - 1 :])
    return at, mix(g[at])


def distinct_per_row(h: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct (row, hash) pairs, sorted by row and then by hash."""
    order = np.lexsort((h, rows))
    h, rows = h[order], rows[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (rows[1:] != rows[:-1])
    return h[keep], rows[keep]


def row_bounds(rows: np.ndarray, n: int) -> np.ndarray:
    """Offsets of each of n rows in a sorted array of row numbers."""
    return np.searchsorted(rows, np.arange(n + 1), side="left")


def signed(h: np.ndarray) -> np.ndarray:
    """uint64 as the int64 that Spark's bigint holds."""
    return h.view(np.int64) if h.dtype == np.uint64 else h.astype(np.int64)
