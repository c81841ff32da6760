"""Compressed FM-index over sequences of symbols, searched for many patterns at once (numpy).

The text is a set of segments. The Burrows-Wheeler transform is kept as a wavelet matrix: one bit
vector per bit of a symbol, packed into 64-bit words with a count per word, so a rank is a lookup
and a population count. Backward search advances a whole vector of patterns one symbol per step.
"""

from __future__ import annotations

import numpy as np

_U = np.uint64
_BELOW = (_U(1) << np.arange(64, dtype=np.uint64)) - _U(1)  # bits below a position of a word


class BitVector:
    def __init__(self, bits: np.ndarray):
        words = -(-(len(bits) + 1) // 64)
        padded = np.zeros(words * 64, dtype=np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        ones = np.bitwise_count(self.words).astype(np.int32)
        self.before = np.cumsum(ones, dtype=np.int32) - ones

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before position i."""
        w = i >> 6
        return self.before.take(w) + np.bitwise_count(self.words.take(w) & _BELOW.take(i & 63))


class FMIndex:
    """``symbols`` are values of any kind of the segments, one after the other; ``lengths`` their lengths."""

    def __init__(self, symbols: np.ndarray, lengths: np.ndarray):
        self.alphabet, code = np.unique(symbols, return_inverse=True)
        n_seg, n = len(lengths), len(symbols) + len(lengths)
        ends = np.cumsum(lengths + 1) - 1
        text = np.zeros(n, dtype=np.int64)
        inner = np.ones(n, dtype=bool)
        inner[ends] = False
        text[inner] = code + 1  # 0 ends a segment
        order = text + n_seg  # ends sort before all symbols and differ from each other
        order[ends] = np.arange(n_seg)
        self.sa = _suffix_array(order)
        self.segment = np.searchsorted(ends, self.sa)  # of the suffix in each row
        bwt = text[self.sa - 1]
        self.first = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=len(self.alphabet) + 1))))
        self.n = n
        self.levels = []
        level = max(1, int(len(self.alphabet)).bit_length())
        for bit in range(level - 1, -1, -1):
            b = ((bwt >> bit) & 1).astype(np.uint8)
            self.levels.append((bit, BitVector(b), int(len(b) - b.sum())))
            bwt = np.concatenate((bwt[b == 0], bwt[b == 1]))
        every = np.arange(len(self.alphabet) + 1)
        self.run = self._ranks(every, np.zeros(len(every), dtype=np.int32))  # where a symbol's run starts in the matrix
        self.shift = (self.first[:-1] - self.run).astype(np.int32)

    def _ranks(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of symbol c before row i, plus where its run starts in the matrix."""
        for bit, vector, zeros in self.levels:
            one = vector.rank(i)
            i = np.where((c >> bit) & 1, zeros + one, i - one)
        return i

    def encode(self, symbols: np.ndarray) -> np.ndarray:
        """Codes of symbols that occur in the text."""
        return np.searchsorted(self.alphabet, symbols) + 1

    def search(self, codes: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows that begin with the ``length`` codes before each of ``ends``, searched backward together."""
        last = codes[ends - 1]
        rows = np.concatenate((self.first[last], self.first[last + 1])).astype(np.int32)  # lower, then upper bounds
        for j in range(2, length + 1):
            c = codes[ends - j].astype(np.int32)
            rows = self._ranks(np.concatenate((c, c)), rows) + np.tile(self.shift[c], 2)
        return rows[: len(ends)].astype(np.int64), rows[len(ends) :].astype(np.int64)

    def least(self, lo: np.ndarray, hi: np.ndarray, value: np.ndarray) -> np.ndarray:
        """Smallest ``value`` of the segments in each (non-empty) row range."""
        ranges, which = np.unique(lo * (self.n + 1) + hi, return_inverse=True)
        a, b = ranges // (self.n + 1), ranges % (self.n + 1)
        v = np.append(value[self.segment], np.iinfo(np.int64).max)
        return np.minimum.reduceat(v, np.stack([a, b], axis=1).ravel())[::2][which]


def _suffix_array(order: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling; ranks become unique after the longest segment at the latest."""
    n, k = len(order), 1
    rank = order
    while True:
        after = np.zeros(n, dtype=np.int64)
        after[: n - k] = rank[k:] + 1
        key = rank * (int(rank.max()) + 2) + after
        sa = np.argsort(key)
        sorted_ = key[sa]
        new = np.concatenate(([0], np.cumsum(sorted_[1:] != sorted_[:-1])))
        rank = np.empty(n, dtype=np.int64)
        rank[sa] = new
        if new[-1] == n - 1 or k >= n:
            return sa
        k *= 2
