"""FM-index of one shard of word numbers: wavelet-matrix ranks, backward search, sampled suffix positions.

Every call works on arrays of queries, so the cost is a few numpy steps a level of the wavelet matrix.
"""

from __future__ import annotations

import numpy as np

#: Numbers 0 and up to FIRST - 1 are not words: a separator ends every run of words.
SEPARATOR, FIRST = 0, 1


def suffixes(text: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling. Each separator counts as a number of its own, so the longest run bounds the rounds."""
    n = len(text)
    ends = text == SEPARATOR
    stops = int(ends.sum())
    rank = np.where(ends, np.cumsum(ends) - 1, text.astype(np.int64) + stops)
    order, step = np.argsort(rank, kind="stable"), 1
    rank = rank + 1
    while True:
        sorted_keys = key[order] if step > 1 else rank[order]
        dense = np.empty(n, np.int64)
        dense[order] = np.cumsum(np.diff(sorted_keys, prepend=sorted_keys[:1]) != 0) + 1
        rank = dense
        if not n or rank[order[-1]] == n or step > n:
            return order
        key = rank * (n + 1)
        key[: n - step] += rank[step:] if step < n else 0
        order = np.argsort(key, kind="stable")
        step *= 2


class Bits:
    """Packed bits with a running count for each 64 of them."""

    def __init__(self, bits: np.ndarray):
        self.n = len(bits)
        packed = np.packbits(bits, bitorder="little")
        self.words = np.zeros(len(bits) // 64 + 1, np.uint64)
        self.words.view(np.uint8)[: len(packed)] = packed
        self.counts = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words))]).astype(np.int64)
        self.zeros = self.n - int(self.counts[-1])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        word = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.counts[word] + np.bitwise_count(self.words[word] & mask)

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)


class FMIndex:
    """Index of `text` (word numbers from FIRST on, SEPARATOR after each run; the last number is a separator)."""

    SAMPLE = 16

    def __init__(self, text: np.ndarray, carry: np.ndarray | None = None):
        """carry: a number for each place of the text; carried has them in the suffixes' order."""
        order = suffixes(text)
        n = len(text)
        last = text[order - 1]
        self.depth = max(1, int(text.max(initial=0)).bit_length())
        self.levels: list[Bits] = []
        now = last
        for level in range(self.depth - 1, -1, -1):
            ones = (now >> level & 1).astype(bool)
            self.levels.append(Bits(ones))
            now = np.concatenate([now[~ones], now[ones]])
        size = int(text.max(initial=0)) + 2
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=size))])  # suffixes that start with a smaller number
        self.base = self._down(np.arange(size - 1), np.zeros(size - 1, np.int64))
        runs = np.concatenate([[True], text[:-1] == SEPARATOR])
        sampled = runs | (np.arange(n) % self.SAMPLE == 0)
        self.marks = Bits(sampled[order])
        self.samples = order[sampled[order]]
        self.carried = None if carry is None else carry[order]

    def _down(self, number: np.ndarray, at: np.ndarray) -> np.ndarray:
        for level, bits in zip(range(self.depth - 1, -1, -1), self.levels, strict=True):
            ones = bits.rank(at)
            at = np.where(number >> level & 1, bits.zeros + ones, at - ones)
        return at

    def rank(self, number: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each number occurs before each place of the transformed text."""
        return self._down(number, at) - self.base[number]

    def step(self, number: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """From the intervals of some patterns to those of the patterns with a number put before them."""
        both = self.first[number] + self.rank(np.concatenate([number, number]), np.concatenate([lo, hi])).reshape(2, -1)
        return both[0], both[1]

    def whole(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        return np.zeros(n, np.int64), np.full(n, self.marks.n, np.int64)

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix intervals of the patterns (one a row, all of one length); empty where lo >= hi."""
        lo, hi = self.whole(len(patterns))
        live = np.arange(len(patterns))
        for at in range(patterns.shape[1] - 1, -1, -1):
            number = patterns[live, at]
            known = number < len(self.base)
            hi[live[~known]] = lo[live[~known]]
            live, number = live[known], number[known]
            lo[live], hi[live] = self.step(number, lo[live], hi[live])
            live = live[lo[live] < hi[live]]
        return lo, hi

    def _last(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The transformed text's number at each place, and the place's image at the lowest level."""
        number = np.zeros(len(at), np.int64)
        for bits in self.levels:
            bit, ones = bits.get(at).astype(bool), bits.rank(at)
            at = np.where(bit, bits.zeros + ones, at - ones)
            number = number << 1 | bit
        return number, at

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix-array rows: walk back to the next sampled position."""
        out, steps = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        live, at = np.arange(len(rows)), rows.astype(np.int64)
        while len(live):
            done = self.marks.get(at).astype(bool)
            out[live[done]] = self.samples[self.marks.rank(at[done])] + steps[live[done]]
            live, at = live[~done], at[~done]
            number, low = self._last(at)
            at = self.first[number] + low - self.base[number]
            steps[live] += 1
        return out
