"""A compressed index of word sequences: depth-bounded FM-index whose BWT lies in a wavelet matrix.

The suffixes are sorted by their first ``depth`` symbols only, ties in text order. Intervals of
patterns up to that depth are contiguous, and backward search over the BWT finds them: the start of
the interval of c+W is the number of symbols below c plus the rank of c before the interval of W.
"""

from __future__ import annotations

import numpy as np


class Bits:
    """A bit vector with rank: words of 64 bits and the ones before each."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.zeros(len(self.words), np.uint32)
        np.cumsum(np.bitwise_count(self.words[:-1]), out=self.before[1:], dtype=np.uint32)

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones among the first i bits."""
        at = i >> 6
        low = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[at].astype(np.int64) + np.bitwise_count(self.words[at] & low)


class WaveletMatrix:
    """Ranks of any symbol below ``sigma`` in a sequence."""

    def __init__(self, symbols: np.ndarray, sigma: int):
        self.levels = max(1, int(sigma - 1).bit_length())
        self.bits, self.zeros = [], []
        starts = np.zeros(sigma, np.int64)
        every, row = np.arange(sigma), symbols
        for level in range(self.levels - 1, -1, -1):
            bit = ((row >> level) & 1).astype(np.uint8)
            bits, zeros = Bits(bit), int(len(row) - bit.sum())
            self.bits.append(bits)
            self.zeros.append(zeros)
            starts = self._down(bits, zeros, starts, (every >> level) & 1)
            row = np.concatenate([row[bit == 0], row[bit == 1]])
        self.starts = starts

    @staticmethod
    def _down(bits: Bits, zeros: int, i: np.ndarray, bit: np.ndarray) -> np.ndarray:
        ones = bits.rank(i)
        return np.where(bit == 1, zeros + ones, i - ones)

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol stands among the first i."""
        for bits, zeros, level in zip(self.bits, self.zeros, range(self.levels - 1, -1, -1)):
            i = self._down(bits, zeros, i, (symbol >> level) & 1)
        return i - self.starts[symbol]


class FMIndex:
    """Index of one text of symbols from 1 on; matches of up to ``depth`` symbols."""

    def __init__(self, text: np.ndarray, depth: int):
        text = np.concatenate([text, [0]])  # the end mark, below all symbols
        n, self.depth = len(text), depth
        ranks, have = np.unique(text, return_inverse=True)[1].astype(np.int64), 1
        while have < depth - 1:  # ranks of prefixes of twice the length, at last of depth - 1
            step = min(have, depth - 1 - have)
            ranks, have = self._longer(ranks, step), have + step
        shorter, ranks = (ranks, self._longer(ranks, 1)) if depth > 1 else (np.zeros(n, np.int64), ranks)
        self.suffix = np.argsort(ranks, kind="stable")
        #: For each place of the order, where the suffixes begin and end that share depth - 1 symbols.
        group = shorter[self.suffix]
        edge = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1], [True]]))
        wide = np.repeat(np.arange(len(edge) - 1), np.diff(edge))
        self.low, self.high = edge[:-1][wide], edge[1:][wide]
        bwt = text[self.suffix - 1]  # read as a circle: the end mark stands before the text
        sigma = int(text.max(initial=0)) + 1
        self.below = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma))])[:sigma]
        self.tree = WaveletMatrix(bwt, sigma)
        self.n = n

    @staticmethod
    def _longer(ranks: np.ndarray, step: int) -> np.ndarray:
        after = np.zeros(len(ranks), np.int64)
        after[: len(ranks) - step] = ranks[step:] + 1
        return np.unique(ranks * (len(ranks) + 1) + after, return_inverse=True)[1].astype(np.int64)

    def back(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the patterns with one more symbol in front."""
        both = self.tree.rank(np.concatenate([symbol, symbol]), np.concatenate([lo, hi]))
        base = self.below[symbol]
        return base + both[: len(lo)], base + both[len(lo) :]

    def stream(self, query: np.ndarray, ends: np.ndarray, most: int):
        """Matching statistics of many queries at a time, from their last symbols backwards.

        ``ends`` are where queries end in ``query``, ``most`` is the longest. For each step it gives
        (places, length of the longest match from there on, at most ``depth``, lo, hi). A symbol the
        index lacks, or a match that ends, starts anew with what is left of it.
        """
        begins = np.concatenate([[0], ends[:-1]])
        lo, hi, long = np.zeros(len(ends), np.int64), np.full(len(ends), self.n), np.zeros(len(ends), np.int64)
        for t in range(most):
            live = np.flatnonzero(ends - t > begins)
            at = ends[live] - t - 1
            a, b, m = lo[live], hi[live], long[live]
            full = np.flatnonzero(m == self.depth)  # drop the last symbol, so that one fits in front
            b[full], a[full] = self.high[a[full]], self.low[a[full]]
            m[full] -= 1
            symbol = query[at]
            known = (symbol > 0) & (symbol < len(self.below))
            x, y = self.back(np.where(known, symbol, 0), a, b)
            ok = known & (y > x)
            for k in np.flatnonzero(~ok).tolist():
                x[k], y[k], m[k] = self._restart(query, int(at[k]), int(m[k]))
            m[ok] += 1
            lo[live], hi[live], long[live] = x, y, m
            yield at, m, x, y

    def _restart(self, query: np.ndarray, at: int, long: int) -> tuple[int, int, int]:
        """The longest match from ``at`` on, shorter than ``long`` + 1 symbols."""
        for m in range(long, 0, -1):
            lo, hi = np.zeros(1, np.int64), np.full(1, self.n)
            for k in range(at + m - 1, at - 1, -1):
                symbol = query[k : k + 1]
                if not 0 < symbol[0] < len(self.below):
                    hi = lo
                    break
                lo, hi = self.back(symbol, lo, hi)
                if hi[0] <= lo[0]:
                    break
            if hi[0] > lo[0]:
                return int(lo[0]), int(hi[0]), m
        return 0, self.n, 0
