"""A word-level FM-index: suffix array, wavelet matrix, vectorised backward search and location."""

from __future__ import annotations

import numpy as np

SAMPLE = 16  # every 16th position of a run keeps its suffix position


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling; every 0 is a separator smaller than all and unlike the others.

    Distinct separators end the doubling after log2(longest run) rounds, whatever the repeats.
    """
    n = len(symbols)
    zero = symbols == 0
    seps = int(zero.sum())
    rank = symbols.astype(np.int64) + max(seps, 1)
    rank[zero] = np.arange(seps)
    h = 1
    while True:
        nxt = np.full(n, -1, np.int64)
        nxt[: n - h] = rank[h:]
        key = rank * (int(rank.max(initial=0)) + 2) + nxt + 1
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        new = np.concatenate(([0], np.cumsum(sorted_key[1:] != sorted_key[:-1])))
        rank = np.empty(n, np.int64)
        rank[order] = new
        if new[-1] == n - 1 or h >= n:
            return order
        h *= 2


class FMIndex:
    """Index of ``symbols`` (0 separates runs; a run starts after a 0 or at position 0)."""

    def __init__(self, symbols: np.ndarray, sigma: int):
        n = len(symbols)
        sa = suffix_array(symbols)
        bwt = symbols[sa - 1]  # position 0 wraps to the last symbol, which is a separator
        self.n, self.levels = n, max(1, int(sigma).bit_length())
        self.first = np.zeros(sigma + 2, np.int64)
        np.cumsum(np.bincount(symbols, minlength=sigma + 1), out=self.first[1:])
        self.ones, self.zeros = [], []
        cur = bwt
        for level in range(self.levels - 1, -1, -1):
            bit = (cur >> level) & 1
            ones = np.zeros(n + 1, np.int64)
            np.cumsum(bit, out=ones[1:])
            self.ones.append(ones)
            self.zeros.append(n - int(ones[-1]))
            cur = np.concatenate((cur[bit == 0], cur[bit == 1]))
        start = np.zeros(n, bool)
        start[0] = True
        start[1:] = symbols[:-1] == 0
        heads = np.maximum.accumulate(np.where(start, np.arange(n), 0))
        kept = (np.arange(n) - heads) % SAMPLE == 0
        self.marked = kept[sa]
        self.sampled = np.where(self.marked, sa, -1)

    def occ(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands in the first ``at`` places of the transformed text."""
        lo, hi = np.zeros_like(at), at
        for level, ones, zeros in zip(range(self.levels - 1, -1, -1), self.ones, self.zeros, strict=True):
            bit = ((symbol >> level) & 1).astype(bool)
            one_lo, one_hi = ones[lo], ones[hi]
            lo = np.where(bit, zeros + one_lo, lo - one_lo)
            hi = np.where(bit, zeros + one_hi, hi - one_hi)
        return hi - lo

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(phrase number, lo, hi) of the phrases that occur; ``phrases`` rows are padded on the right."""
        who = np.arange(len(phrases))
        lo, hi = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        for step in range(int(lengths.max(initial=0))):
            at = lengths[who] - 1 - step
            going = at >= 0
            if going.any():
                symbol = phrases[who[going], at[going]].astype(np.int64)
                lo[going] = self.first[symbol] + self.occ(symbol, lo[going])
                hi[going] = self.first[symbol] + self.occ(symbol, hi[going])
            live = hi > lo
            who, lo, hi = who[live], lo[live], hi[live]
        return who, lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix-array rows: walk back to a sampled one, at most SAMPLE steps."""
        out = np.full(len(rows), -1, np.int64)
        todo, cur, step = np.arange(len(rows)), rows.astype(np.int64), 0
        while len(todo):
            done = self.marked[cur]
            out[todo[done]] = self.sampled[cur[done]] + step
            todo, cur = todo[~done], cur[~done]
            symbol, at = np.zeros(len(cur), np.int64), cur
            lo = np.zeros(len(cur), np.int64)
            for ones, zeros in zip(self.ones, self.zeros, strict=True):
                bit = (ones[at + 1] - ones[at]).astype(bool)
                symbol = symbol * 2 + bit
                at = np.where(bit, zeros + ones[at], at - ones[at])
                lo = np.where(bit, zeros + ones[lo], lo - ones[lo])
            cur = self.first[symbol] + at - lo
            step += 1
        return out
