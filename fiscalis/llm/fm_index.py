"""A word-level FM-index in numpy: Burrows-Wheeler transform in a wavelet matrix.

The alphabet is the shard's own words, so a word takes log2(vocabulary) bits,
plus half as much again for rank counts. Searches run over many patterns at once.
"""

from __future__ import annotations

import numpy as np


class WaveletMatrix:
    """Rank queries on a sequence of small integers."""

    def __init__(self, values: np.ndarray, symbols: int):
        self.levels = max(1, int(symbols - 1).bit_length())
        self.words, self.ones_before, self.zeros = [], [], []
        for level in range(self.levels - 1, -1, -1):
            bit = (values >> level) & 1 == 1
            packed = np.zeros((len(bit) + 64) // 64 * 8, dtype=np.uint8)
            packed[:(len(bit) + 7) // 8] = np.packbits(bit, bitorder="little")
            words = packed.view(np.uint64)
            self.words.append(words)
            self.ones_before.append(np.r_[0, np.cumsum(np.bitwise_count(words), dtype=np.int64)[:-1]].astype(np.int32))
            self.zeros.append(int(len(bit) - bit.sum()))
            values = np.concatenate([values[~bit], values[bit]])
        self.origin = self._walk(np.arange(symbols), np.zeros(symbols, dtype=np.int64))

    def _walk(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for k in range(self.levels):
            word = at >> 6
            below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
            ones = self.ones_before[k][word] + np.bitwise_count(self.words[k][word] & below)
            one = (symbol >> (self.levels - 1 - k)) & 1 == 1
            at = np.where(one, self.zeros[k] + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each position."""
        return self._walk(symbol, at) - self.origin[symbol]


class FMIndex:
    """Index of texts given as word ids (1 and up), joined with 0 between them.

    Suffixes are sorted by their first 32 words; that is exact for patterns of
    up to 31 words, which is all that is asked of it.
    """

    DEPTH = 32

    def __init__(self, ids: np.ndarray, symbols: int):
        n = len(ids)
        rank, width = ids.astype(np.int64), 1
        ranks = {1: rank}
        while width < self.DEPTH:
            after = np.zeros(n, dtype=np.int64)
            after[:max(n - width, 0)] = rank[width:] + 1
            pair = rank * (n + symbols + 2) + after
            order = np.argsort(pair, kind="stable")
            changed = np.r_[True, pair[order][1:] != pair[order][:-1]]
            rank = np.empty(n, dtype=np.int64)
            rank[order] = np.cumsum(changed) - 1
            width *= 2
            ranks[width] = rank
        self.suffixes, self.rank8 = order, ranks[8]
        self.before = np.r_[0, np.cumsum(np.bincount(ids, minlength=symbols))][:symbols]
        self.size, self.matrix = n, WaveletMatrix(ids[order - 1].astype(np.int64), symbols)

    def extend(self, word: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One step of backward search: intervals of the patterns with `word` put in front."""
        return self.before[word] + self.matrix.rank(word, low), self.before[word] + self.matrix.rank(word, high)

    def groups(self, window: int) -> np.ndarray:
        """For each place in suffix order, a number shared by suffixes that agree in `window` (8 to 16) words."""
        head = self.rank8[self.suffixes]
        tail = np.r_[self.rank8, np.full(window, -1)][self.suffixes + window - 8]
        return np.cumsum(np.r_[True, (head[1:] != head[:-1]) | (tail[1:] != tail[:-1])]) - 1

    def intervals(self, starts: np.ndarray, ends: np.ndarray, ids: np.ndarray, window: int):
        """Backward search of many patterns `ids[starts:ends]` at once.

        Yields (pattern numbers, positions, low, high): the suffixes that begin with the
        rest of a pattern from a position on, wherever that rest has at least `window` words.
        """
        longest = np.argsort(starts - ends, kind="stable")
        length = (ends - starts)[longest]
        low = np.zeros(len(starts), dtype=np.int64)
        high = np.full(len(starts), self.size, dtype=np.int64)
        for step in range(1, int(length.max(initial=0)) + 1):
            live = int(np.searchsorted(-length, -step, side="right"))
            which = longest[:live]
            at = ends[which] - step
            low, high = self.extend(ids[at], low[:live], high[:live])
            if step >= window:
                yield which, at - starts[which], low, high
