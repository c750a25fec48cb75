"""An FM-index over integer symbols: suffix order, wavelet ranks, backward search and sampled positions, all in numpy.

Symbol 0 separates texts and never matches: each separator is unlike any other in the suffix order. The last symbol must be one, so
an index of nothing is that of [0]. Repeated texts are found at each of their places; a phrase that isn't there has an empty range.
"""

from __future__ import annotations

import numpy as np


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Starts of all suffixes in order, by prefix doubling. The last symbol must be a separator."""
    n = len(symbols)
    parts = symbols == 0
    rank = np.where(parts, np.cumsum(parts) - 1, int(parts.sum()) + symbols.astype(np.int64))
    span = 1
    while True:
        after = np.zeros(n, np.int64)
        after[: n - span] = rank[span:] + 1
        key = rank * (int(rank.max()) + 2) + after
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        fresh = np.empty(n, np.int64)
        fresh[order] = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
        rank = fresh
        if rank[order[-1]] == n - 1:
            return order
        span *= 2


class WaveletRanks:
    """A wavelet tree stored level by level (zeros before ones on each): how often a symbol is in a prefix, and what stands at a place."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.bits, self.levels = bits, []
        now = symbols
        for level in range(bits - 1, -1, -1):
            bit = ((now >> level) & 1).astype(bool)
            words = np.packbits(bit, bitorder="little")
            words = np.frombuffer(np.concatenate([words, np.zeros(-len(words) % 8 + 8, np.uint8)]).tobytes(), "<u8")
            before = np.concatenate([[0], np.cumsum(np.bitwise_count(words))]).astype(np.int64)
            self.levels.append((words, before, int(len(now) - bit.sum())))
            now = np.concatenate([now[~bit], now[bit]])

    @staticmethod
    def _ones(words: np.ndarray, before: np.ndarray, at: np.ndarray) -> np.ndarray:
        w, r = at >> 6, (at & 63).astype(np.uint64)
        return before[w] + np.bitwise_count(words[w] & ((np.uint64(1) << r) - np.uint64(1)))

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place."""
        low, high = np.zeros_like(at), at
        for level, (words, before, zeros) in zip(range(self.bits - 1, -1, -1), self.levels, strict=True):
            one = ((symbol >> level) & 1).astype(bool)
            a, z = self._ones(words, before, low), self._ones(words, before, high)
            low, high = np.where(one, zeros + a, low - a), np.where(one, zeros + z, high - z)
        return high - low

    def access(self, at: np.ndarray) -> np.ndarray:
        symbol = np.zeros_like(at)
        for words, before, zeros in self.levels:
            one = ((words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)
            ones = self._ones(words, before, at)
            symbol = symbol * 2 + one
            at = np.where(one, zeros + ones, at - ones)
        return symbol


class FMIndex:
    """`sample`: every so many positions of the text are kept for `locate`, and all that follow a separator."""

    def __init__(self, symbols: np.ndarray, sample: int = 16):
        order = suffix_order(symbols)
        self.bits = max(1, int(symbols.max()).bit_length())
        last = symbols[order - 1]  # what stands before each suffix; before the first, the last separator
        self.ranks = WaveletRanks(last.astype(np.int64), self.bits)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=1 << self.bits))]).astype(np.int64)
        marked = (order % sample == 0) | (last == 0)
        self.kept = order[marked]
        self.marks = WaveletRanks(marked.astype(np.int64), 1)
        self.n = len(symbols)

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranges of the suffix order, one for each row of `phrases` (all of one length), by backward search."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        alive = np.arange(len(phrases))
        for k in range(phrases.shape[1] - 1, -1, -1):
            c = phrases[alive, k]
            a = self.before[c] + self.ranks.rank(c, low[alive])
            z = self.before[c] + self.ranks.rank(c, high[alive])
            low[alive], high[alive] = a, z
            alive = alive[a < z]
            if not len(alive):
                break
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of places of the suffix order: steps back until a sampled position."""
        at, steps, out = rows.astype(np.int64), np.zeros(len(rows), np.int64), np.full(len(rows), -1, np.int64)
        todo = np.arange(len(rows))
        while len(todo):
            here = at[todo]
            marked = self.marks.access(here).astype(bool)
            done = todo[marked]
            out[done] = self.kept[self.marks.rank(np.ones(len(done), np.int64), at[done])] + steps[done]
            todo = todo[~marked]
            here = at[todo]
            c = self.ranks.access(here)
            at[todo] = self.before[c] + self.ranks.rank(c, here)
            steps[todo] += 1
        return out
