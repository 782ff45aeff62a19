"""FM-index over a sequence of small integers, kept in numpy arrays of one shard.

Symbol 0 separates stretches of text and occurs in no pattern. Ranks come from a wavelet matrix (one bit vector per
binary digit of the symbols, counted by 64-bit words), positions from suffixes sampled at every ``step``-th place.
"""

from __future__ import annotations

import numpy as np


class Bits:
    """Bit vector with constant-time rank."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, bool)
        padded[:len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)))

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Set bits before each position."""
        word, bit = i >> 6, (i & 63).astype(np.uint64)
        low = self.words[word] & ((np.uint64(1) << bit) - np.uint64(1))
        return self.before[word] + np.bitwise_count(low)

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1) == 1


class WaveletMatrix:
    def __init__(self, values: np.ndarray, top: int):
        self.levels: list[tuple[int, Bits, int]] = []
        for shift in range(max(1, int(top).bit_length()) - 1, -1, -1):
            bit = (values >> shift) & 1 == 1
            zeros = int(len(bit) - bit.sum())
            self.levels.append((shift, Bits(bit), zeros))
            values = np.concatenate((values[~bit], values[bit]))

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each position."""
        start, end = np.zeros_like(i), i
        for shift, bits, zeros in self.levels:
            one = (symbol >> shift) & 1 == 1
            a, b = bits.rank(start), bits.rank(end)
            start, end = np.where(one, zeros + a, start - a), np.where(one, zeros + b, end - b)
        return end - start


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffix order by prefix doubling; separators differ from each other and order by position."""
    n = len(text)
    rank = text.astype(np.int64)
    cuts = np.flatnonzero(rank == 0)
    rank += len(cuts)
    rank[cuts] = np.arange(len(cuts))
    order = np.argsort(rank, kind="stable")
    step = 1
    while True:
        ordered = rank[order]
        new = np.concatenate(([0], np.cumsum(ordered[1:] != ordered[:-1])))
        rank[order] = new
        if n == 0 or new[-1] == n - 1:
            return order
        # only ties are sorted again
        same = np.concatenate(([False], new[1:] == new[:-1]))
        tied = np.flatnonzero(same | np.concatenate((same[1:], [False])))
        at = order[tied]
        key = rank[at] * (n + 1) + np.where(at + step < n, rank[np.minimum(at + step, n - 1)] + 1, 0)
        sort = np.argsort(key, kind="stable")
        order[tied] = at[sort]
        pair = np.full(n, -1, np.int64)
        pair[tied] = key[sort]
        # a place opens a new rank when its old rank or its pair differs from the one before
        opens = np.concatenate(([True], (new[1:] != new[:-1]) | (pair[1:] != pair[:-1])))
        rank[order] = np.cumsum(opens) - 1
        step *= 2


class FMIndex:
    def __init__(self, text: np.ndarray, top: int, step: int = 8):
        """``text`` holds symbols up to ``top`` and ends with a separator."""
        order = suffix_array(text)
        self.n = len(text)
        self.bwt = text[order - 1] if self.n else text
        counts = np.bincount(text, minlength=top + 2)
        self.first = np.concatenate(([0], np.cumsum(counts)))[:top + 2].astype(np.int64)
        self.wavelet = WaveletMatrix(self.bwt, top)
        # the starts of stretches are sampled too, so that no walk has to step over a separator
        kept = (order % step == 0) | (self.bwt == 0)
        self.sampled, self.places = Bits(kept), order[kept]

    def find(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix range of each row of ``patterns``, all of one length."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        live = np.arange(len(patterns))
        for j in range(patterns.shape[1] - 1, -1, -1):
            symbol = patterns[live, j]
            low[live] = self.first[symbol] + self.wavelet.rank(symbol, low[live])
            high[live] = self.first[symbol] + self.wavelet.rank(symbol, high[live])
            live = live[low[live] < high[live]]
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text position of each suffix row, by walking back to a sampled one."""
        rows, steps = rows.copy(), np.zeros(len(rows), np.int64)
        live = np.flatnonzero(~self.sampled.get(rows))
        while len(live):
            symbol = self.bwt[rows[live]]
            rows[live] = self.first[symbol] + self.wavelet.rank(symbol, rows[live])
            steps[live] += 1
            live = live[~self.sampled.get(rows[live])]
        return self.places[self.sampled.rank(rows)] + steps
