"""A full-text index in little space: Burrows-Wheeler transform in a wavelet matrix.

Built over many short word sequences at once.  Suffixes are sorted by their
first ``depth`` words, which orders every pattern of fewer words exactly.  The
transform is kept as one packed bit vector for each bit of a word's number,
with running counts for each 64 bits; a backward step takes two ranks on each
level, for many patterns at once.
"""

from __future__ import annotations

import numpy as np

U64 = np.uint64


class BitVector:
    def __init__(self, bits: np.ndarray):
        n = len(bits)
        padded = np.zeros((n // 64 + 1) * 64, np.uint8)
        padded[:n] = bits
        self.words = np.packbits(padded, bitorder="little").view(U64)
        self.before = np.zeros(len(self.words) + 1, np.int64)
        np.cumsum(np.bitwise_count(self.words), out=self.before[1:])
        self.zeros = n - int(self.before[-1])

    def rank1(self, at: np.ndarray) -> np.ndarray:
        """Set bits before each place."""
        word = at >> 6
        below = (U64(1) << (at & 63).astype(U64)) - U64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & below)


class WaveletMatrix:
    def __init__(self, symbols: np.ndarray, top: int):
        self.levels: list[tuple[int, BitVector]] = []
        left = symbols
        for shift in range(max(1, int(top).bit_length()) - 1, -1, -1):
            bits = ((left >> shift) & 1).astype(np.uint8)
            self.levels.append((shift, BitVector(bits)))
            left = np.concatenate([left[bits == 0], left[bits == 1]])
        self.first = self.walk(np.arange(top + 1), np.zeros(top + 1, np.int64))

    def walk(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for shift, bits in self.levels:
            ones = bits.rank1(at)
            at = np.where((symbol >> shift) & 1, bits.zeros + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place."""
        return self.walk(symbol, at) - self.first[symbol]


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Places in the order of the suffixes' first ``depth`` or more symbols, by prefix doubling."""
    n = len(text)
    rank, step = text.astype(np.int64), 1
    order = np.argsort(rank, kind="stable")
    while step < depth:
        after = np.zeros(n, np.int64)
        after[: n - step] = rank[step:] + 1
        key = rank * (n + 2) + after
        order = np.argsort(key, kind="stable")
        ranked = key[order]
        new = np.zeros(n, np.int64)
        np.cumsum(ranked[1:] != ranked[:-1], out=new[1:])
        rank = np.empty(n, np.int64)
        rank[order] = new
        step *= 2
        if n and new[-1] == n - 1:
            break
    return order


class FMIndex:
    """texts: arrays of numbers from 1; weights: how often each counts."""

    def __init__(self, texts: list[np.ndarray], weights: np.ndarray, depth: int):
        lengths = np.array([len(t) for t in texts], np.int64)
        self.ends = np.cumsum(lengths + 1) - 1
        self.starts = self.ends - lengths
        self.text = np.zeros(int(lengths.sum()) + len(texts), np.int64)
        inside = np.ones(len(self.text), bool)
        inside[self.ends] = False
        self.text[inside] = np.concatenate(texts) if len(texts) else []
        order = suffix_order(self.text, depth)
        top = int(self.text.max(initial=0))
        self.size = len(self.text)
        self.bwt = WaveletMatrix(self.text[order - 1], top)
        self.less = np.concatenate([[0], np.cumsum(np.bincount(self.text, minlength=top + 1))])
        owner = np.repeat(np.arange(len(texts)), lengths + 1)
        self.weight = np.concatenate([[0], np.cumsum(np.asarray(weights, np.int64)[owner[order]])])

    def step(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the patterns with one more symbol in front."""
        both = self.bwt.rank(np.concatenate([symbol, symbol]), np.concatenate([lo, hi])) + np.concatenate([self.less[symbol]] * 2)
        return both[: len(lo)], both[len(lo) :]

    def occurrences(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return self.weight[hi] - self.weight[lo]


def matched_intervals(index: FMIndex, least: int) -> list[list[tuple[int, int]]]:
    """For each indexed text the maximal spans of ``least`` or more symbols that occur twice or more.

    Every text is read from its end by backward search.  [j, e) is the longest
    repeated match that ends at e.  Where one more symbol x in front fails, the
    match is cut from behind to the longest repeated [x, f), f found by halving;
    reading goes on from there, so a mismatch costs a few dozen steps.
    """
    n = len(index.starts)
    out: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    lane = np.flatnonzero(index.ends - index.starts >= least)
    b, e = index.starts[lane].copy(), index.ends[lane].copy()
    j, lo, hi = e.copy(), np.zeros(len(lane), np.int64), np.full(len(lane), index.size, np.int64)
    probing = np.zeros(len(lane), bool)  # halving for f: (good, bad) bracket it, goal is x
    good, bad, goal = np.zeros_like(e), np.zeros_like(e), np.zeros_like(e)
    keep_lo, keep_hi = np.zeros_like(e), np.zeros_like(e)
    while len(lane):
        nlo, nhi = index.step(index.text[j - 1], lo, hi)
        fits = index.occurrences(nlo, nhi) >= 2
        done = np.zeros(len(lane), bool)
        # reading on
        go = fits & ~probing
        j[fits] -= 1
        lo[fits], hi[fits] = nlo[fits], nhi[fits]
        at_start = go & (j == b)
        stop = ~fits & ~probing
        for k in np.flatnonzero((at_start | stop) & (e - j >= least)):
            out[lane[k]].append((int(j[k] - b[k]), int(e[k] - b[k])))
        done |= at_start
        # a match ends at x = j - 1: begin to look for f in (x, e)
        goal[stop], good[stop], bad[stop] = j[stop] - 1, j[stop] - 1, e[stop]
        keep_lo[stop], keep_hi[stop] = 0, index.size
        # a probe that reached x, or failed before it
        reached = probing & fits & (j == goal)
        good[reached] = e[reached]
        keep_lo[reached], keep_hi[reached] = lo[reached], hi[reached]
        failed = probing & ~fits
        bad[failed] = e[failed]
        look = stop | reached | failed
        probing |= stop
        settled = look & (bad - good <= 1)
        again = look & ~settled
        e[again] = (good[again] + bad[again]) // 2
        j[again], lo[again], hi[again] = e[again], 0, index.size
        e[settled], j[settled] = good[settled], goal[settled]
        lo[settled], hi[settled] = keep_lo[settled], keep_hi[settled]
        probing[settled] = False
        # what is left in front of f is too short, or wholly read
        short = settled & (e - b < least)
        done |= short | (settled & (j == b) & ~short)
        for k in np.flatnonzero(settled & ~short & (j == b) & (e - j >= least)):
            out[lane[k]].append((int(j[k] - b[k]), int(e[k] - b[k])))
        if done.any():
            m = ~done
            lane, b, e, j, lo, hi, probing = lane[m], b[m], e[m], j[m], lo[m], hi[m], probing[m]
            good, bad, goal, keep_lo, keep_hi = good[m], bad[m], goal[m], keep_lo[m], keep_hi[m]
    return out
