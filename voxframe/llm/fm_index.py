"""An FM-index over integer sequences: Burrows-Wheeler transform in a wavelet matrix, searched backwards for many patterns at once."""

from __future__ import annotations

import numpy as np


def sort_suffixes(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in order of their first `depth` symbols or more, by prefix doubling."""
    n = len(text)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    order = np.argsort(rank, kind="stable")
    h = 1
    while h < depth:
        beyond = np.zeros(n, np.int64)
        beyond[: n - h] = rank[h:] + 1
        key = rank * (n + 1) + beyond
        order = np.argsort(key, kind="stable")
        step = np.ones(n, np.int64)
        step[0] = 0
        step[1:] = key[order[1:]] != key[order[:-1]]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(step)
        h *= 2
    return order


class Bits:
    """A bit vector with counts before each 64-bit word."""

    def __init__(self, bits: np.ndarray) -> None:
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        counts = np.bitwise_count(self.words).astype(np.int64)
        self.before = np.cumsum(counts) - counts

    def ones(self, at: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        word = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)


class FMIndex:
    """Counts and finds patterns of up to `depth` symbols. Symbol 0 ends a sequence and is in no pattern."""

    def __init__(self, text: np.ndarray, depth: int) -> None:
        self.suffixes = sort_suffixes(text, depth)
        bwt = text[self.suffixes - 1]
        sigma = int(text.max()) + 1
        starts = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma))])[:-1]
        self.levels = []
        symbols = bwt
        at = np.zeros(sigma, np.int64)  # where the occurrences of each symbol begin, level by level
        all_symbols = np.arange(sigma)
        for shift in range(max(1, (sigma - 1).bit_length()) - 1, -1, -1):
            bit = (symbols >> shift) & 1
            bits, zeros = Bits(bit.astype(np.uint8)), int(len(bit) - bit.sum())
            self.levels.append((shift, bits, zeros))
            ones = bits.ones(at)
            at = np.where((all_symbols >> shift) & 1, zeros + ones, at - ones)
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])
        self.shift = starts - at

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals after one more symbol in front of the patterns of the intervals given."""
        n = len(low)
        at, both = np.concatenate([low, high]), np.concatenate([symbol, symbol])
        for shift, bits, zeros in self.levels:
            ones = bits.ones(at)
            at = np.where((both >> shift) & 1, zeros + ones, at - ones)
        at += self.shift[both]
        return at[:n], at[n:]

    def search(self, text: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Matching statistics of text[end-length:end] for every end: the interval of the whole, empty once a step fails.

        All patterns take their steps together; those that no other place matches (an interval
        of one) leave early, as they can only match themselves.
        """
        low, high = np.zeros(len(ends), np.int64), np.full(len(ends), len(self.suffixes), np.int64)
        on = np.arange(len(ends))
        for step in range(1, length + 1):
            low[on], high[on] = self.extend(text[ends[on] - step], low[on], high[on])
            on = on[high[on] - low[on] > 1]
        high[high - low == 1] = low[high - low == 1]
        return low, high
