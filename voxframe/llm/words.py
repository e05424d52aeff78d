"""Words of Arrow text columns as numpy arrays: positions, hashes and n-gram hashes.

A word is a run of bytes other than space and \\t \\n \\v \\f \\r. Everything is computed
over whole slices of a batch at once; no Python object is made per word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_BYTE = np.uint64(0x9E3779B97F4A7C15)
_WORD = np.uint64(0xD6E8FEB86659FD93)


def _inverse(odd: np.uint64) -> np.uint64:
    return np.uint64(pow(int(odd), -1, 1 << 64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every bit of a 64-bit value over all bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def ranges(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[0], first[0]+1, ... count[0] of them, then those of the next."""
    total = int(count.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(count)
    return np.arange(total, dtype=np.int64) - np.repeat(ends - count, count) + np.repeat(first, count)


def sums(keys: np.ndarray, base: np.uint64, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Position-independent hash of keys[start:end] for every pair of start and end."""
    n = len(keys)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(keys * _powers(base, n)[:n], out=total[1:])
    return mix((total[end] - total[start]) * _powers(_inverse(base), n)[start] + (end - start).astype(np.uint64))


@dataclass
class Words:
    data: np.ndarray  # bytes of the slice
    first: np.ndarray  # of each text the first word, and the end of the last text
    start: np.ndarray  # of each word, in bytes
    end: np.ndarray
    hash: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hash, first word, number per text) of all runs of k words; a shorter text is one run."""
        n = self.counts
        per = np.where(n >= k, n - k + 1, (n > 0).astype(n.dtype))
        at = ranges(self.first[:-1], per)
        size = np.repeat(np.minimum(n, k), per)
        return sums(self.hash, _WORD, at, at + size), at, per


def _large(column: pa.Array) -> pa.Array:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.large_binary())


def slices(column: pa.Array, limit: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(row, end row, bytes, offsets) of stretches of about `limit` bytes; a longer text stands alone."""
    column = _large(column)
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        stop = min(stop, n)
        yield row, stop, data[offsets[row] : offsets[stop]], offsets[row : stop + 1] - offsets[row]
        row = stop


def words(data: np.ndarray, offsets: np.ndarray) -> Words:
    space = (data == 32) | ((data >= 9) & (data <= 13))
    lead, tail = ~space, ~space
    lead[1:] &= space[:-1]
    tail[:-1] &= space[1:]
    # a text's edge also ends a word
    edges = offsets[1:-1]
    inner = edges[(edges > 0) & (edges < len(data))]
    lead[inner] = ~space[inner]
    tail[inner - 1] = ~space[inner - 1]
    start, end = np.flatnonzero(lead), np.flatnonzero(tail) + 1
    return Words(data, np.searchsorted(start, offsets), start, end, sums(data.astype(np.uint64) + np.uint64(1), _BYTE, start, end))
