"""An FM-index over integer symbols: wavelet-matrix ranks, backward search, sampled suffix positions."""

from __future__ import annotations

import numpy as np


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffix order of symbols that end with their only 0, by prefix doubling from as many symbols as fit 63 bits.

    The rank of a suffix is the first place of its group of ties in the order; only ties are sorted again in each round.
    """
    n, bits = len(text), max(1, int(text.max()).bit_length())
    span = max(1, 63 // bits)
    key = np.zeros(n, np.int64)
    for j in range(span):
        key <<= bits
        key[: max(n - j, 0)] |= text[j:]
    order = np.argsort(key)
    rank = np.zeros(n, np.int64)
    tied, key = np.arange(n), key[order]
    while True:
        heads = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        sizes = np.diff(np.concatenate((heads, [len(tied)])))
        rank[order[tied]] = np.repeat(tied[heads], sizes)
        tied = tied[np.repeat(sizes, sizes) > 1]
        if not len(tied):
            return order
        suffixes = order[tied]
        after = np.where(suffixes + span < n, rank[np.minimum(suffixes + span, n - 1)] + 1, 0)
        key = rank[suffixes] << 32 | after
        again = np.argsort(key)
        order[tied], key = suffixes[again], key[again]
        span *= 2


class WaveletMatrix:
    """rank(c, i): how often symbol c occurs before place i, for whole vectors of (c, i)."""

    def __init__(self, symbols: np.ndarray, sigma: int):
        self.levels = max(1, int(sigma - 1).bit_length())
        self.ones, self.zeros = [], []
        current = symbols
        for level in range(self.levels - 1, -1, -1):
            bit = (current >> level) & 1
            self.ones.append(np.concatenate(([0], np.cumsum(bit))).astype(np.int32 if len(symbols) < 1 << 31 else np.int64))
            self.zeros.append(int(len(bit) - bit.sum()))
            current = np.concatenate((current[bit == 0], current[bit == 1]))

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        lo, hi = np.zeros_like(i), i.copy()
        for k, level in enumerate(range(self.levels - 1, -1, -1)):
            ones, zeros = self.ones[k], self.zeros[k]
            one = ((c >> level) & 1).astype(bool)
            a, b = ones[lo], ones[hi]
            lo = np.where(one, zeros + a, lo - a)
            hi = np.where(one, zeros + b, hi - b)
        return hi - lo

    def access(self, i: np.ndarray) -> np.ndarray:
        out, at = np.zeros_like(i), i.copy()
        for k in range(self.levels):
            ones, zeros = self.ones[k], self.zeros[k]
            before = ones[at]
            bit = ones[at + 1] - before
            out = (out << 1) | bit
            at = np.where(bit == 1, zeros + before, at - before)
        return out


class FMIndex:
    """Index of one shard: symbols are 1 and up; 0 is the end mark that is added here."""

    def __init__(self, symbols: np.ndarray, sigma: int, sample: int = 16):
        text = np.concatenate((symbols, [0])).astype(np.int64)
        sa = suffix_array(text)
        bwt = text[sa - 1]
        self.n, self.sigma = len(text), sigma
        self.before = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=sigma))))
        self.wavelet = WaveletMatrix(bwt, sigma)
        kept = sa % sample == 0
        self.kept_rank = np.concatenate(([0], np.cumsum(kept)))
        self.kept_at = sa[kept]

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row intervals [lo, hi) of the suffixes that begin with each pattern (rows of a padded matrix)."""
        lo = np.zeros(len(patterns), np.int64)
        hi = np.full(len(patterns), self.n, np.int64)
        for j in range(patterns.shape[1] - 1, -1, -1):
            live = np.flatnonzero((j < lengths) & (lo < hi))
            c = patterns[live, j]
            begin = self.before[c]
            both = self.wavelet.rank(np.concatenate((c, c)), np.concatenate((lo[live], hi[live])))
            lo[live], hi[live] = begin + both[: len(c)], begin + both[len(c) :]
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Places of suffixes, by walking back to sampled ones."""
        rows = rows.copy()
        out = np.zeros(len(rows), np.int64)
        steps = np.zeros(len(rows), np.int64)
        left = np.arange(len(rows))
        while len(left):
            at = rows[left]
            known = self.kept_rank[at + 1] > self.kept_rank[at]
            done = left[known]
            out[done] = self.kept_at[self.kept_rank[rows[done]]] + steps[done]
            left, at = left[~known], at[~known]
            c = self.wavelet.access(at)
            rows[left] = self.before[c] + self.wavelet.rank(c, at)
            steps[left] += 1
        return out
