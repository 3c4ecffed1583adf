"""An FM-index over the word sequence of one training shard: wavelet-matrix ranks and sampled suffix positions."""

from __future__ import annotations

import numpy as np

#: One suffix position in so many is kept; the others are found by walking back to one.
SAMPLE = 8


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling. Each separator (symbol 0) counts as a symbol of its own.

    So no two suffixes are alike beyond the next separator, and doubling ends with the longest
    run of words between two of them.
    """
    n = len(symbols)
    separators = np.flatnonzero(symbols == 0)
    rank = symbols.astype(np.int64) + len(separators)
    rank[separators] = np.arange(len(separators))
    order, step = np.argsort(rank, kind="stable"), 1
    # A rank is the place of the first suffix that has it.
    fresh = np.concatenate([[True], rank[order][1:] != rank[order][:-1]])
    rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    while True:
        ordered = rank[order]
        same = ordered[1:] == ordered[:-1]
        if not same.any():
            return order
        # Only suffixes that share their rank with another one are sorted again.
        tied = np.zeros(n, bool)
        tied[1:] |= same
        tied[:-1] |= same
        places = np.flatnonzero(tied)
        rows = order[places]
        ahead = rows + step
        second = np.where(ahead < n, rank[np.minimum(ahead, n - 1)], -1)
        first = rank[rows]
        again = np.lexsort((second, first))
        rows, first, second = rows[again], first[again], second[again]
        order[places] = rows
        new = np.ones(len(rows), bool)
        new[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
        rank[rows] = np.maximum.accumulate(np.where(new, places, 0))
        step *= 2


class WaveletMatrix:
    """Ranks of symbols in a sequence, one bit level at a time, for many queries at once."""

    def __init__(self, values: np.ndarray, sigma: int):
        self.levels = max(1, int(sigma - 1).bit_length())
        self.zeros, self.n_zero = [], []
        rest = values
        for level in range(self.levels - 1, -1, -1):
            bit = (rest >> level) & 1
            count = np.zeros(len(rest) + 1, np.int32)
            np.cumsum(bit == 0, out=count[1:])
            self.zeros.append(count)
            self.n_zero.append(int(count[-1]))
            rest = np.concatenate([rest[bit == 0], rest[bit == 1]])
        self.origin = self._descend(np.arange(sigma), np.zeros(sigma, np.int64))

    def _descend(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        for k in range(self.levels):
            zeros = self.zeros[k][at]
            one = (symbols >> (self.levels - 1 - k)) & 1
            at = np.where(one == 1, self.n_zero[k] + at - zeros, zeros)
        return at

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each place."""
        return self._descend(symbols, at) - self.origin[symbols]

    def access_rank(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each place and how often it occurs before."""
        symbols, here = np.zeros(len(at), np.int64), at
        for k in range(self.levels):
            zeros = self.zeros[k][here]
            one = self.zeros[k][here + 1] == zeros
            symbols = symbols * 2 + one
            here = np.where(one, self.n_zero[k] + here - zeros, zeros)
        return symbols, here - self.origin[symbols]


class FMIndex:
    """Index of a sequence of symbols 0..sigma-1 in which 0 separates; phrases hold no 0."""

    def __init__(self, symbols: np.ndarray, sigma: int):
        order = suffix_order(symbols)
        self.n = len(symbols)
        last = symbols[order - 1]
        self.ranks = WaveletMatrix(last.astype(np.int64), sigma)
        count = np.bincount(symbols, minlength=sigma)
        self.below = np.concatenate([[0], np.cumsum(count)])
        # Positions after a separator are kept too, so that no walk crosses one.
        kept = (order % SAMPLE == 0) | (last == 0)
        self.kept = kept
        self.kept_before = np.concatenate([[0], np.cumsum(kept)])
        self.kept_position = order[kept]

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges [lo, hi) of phrases, given as a matrix aligned to the right, by backward search."""
        width = phrases.shape[1]
        lo, hi = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        alive = np.arange(len(phrases))
        for k in range(1, width + 1):
            alive = alive[(lengths[alive] >= k) & (lo[alive] < hi[alive])]
            if not len(alive):
                break
            symbol = phrases[alive, width - k]
            both = self.ranks.rank(np.concatenate([symbol, symbol]), np.concatenate([lo[alive], hi[alive]]))
            base = self.below[symbol]
            lo[alive], hi[alive] = base + both[: len(alive)], base + both[len(alive) :]
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows: walk back until a sampled one."""
        rows, steps, position = rows.copy(), np.zeros(len(rows), np.int64), np.full(len(rows), -1, np.int64)
        open_ = np.arange(len(rows))
        while len(open_):
            here = rows[open_]
            done = self.kept[here]
            found = open_[done]
            position[found] = self.kept_position[self.kept_before[rows[found]]] + steps[found]
            open_ = open_[~done]
            if len(open_):
                symbol, before = self.ranks.access_rank(rows[open_])
                rows[open_] = self.below[symbol] + before
                steps[open_] += 1
        return position
