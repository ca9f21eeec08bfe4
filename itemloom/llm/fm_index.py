"""A compressed FM-index over the word sequences of one shard.

The Burrows-Wheeler transform is held in a wavelet matrix (bit vectors with a
rank directory).  Backward search extends a match to the left; when the
extended match would occur fewer than ``least`` times, the match is shortened
from the right by moving to the parent interval (the longest shorter match
with more occurrences), found through the LCP array.  The lengths reached are
the matching statistics of the streamed words.
"""

from __future__ import annotations

import numpy as np


class BitVector:
    """Packed bits with a running count for each 64-bit word."""

    def __init__(self, bits: np.ndarray):
        n = len(bits)
        packed = np.packbits(bits, bitorder="little")
        self.words = np.zeros(n // 64 + 1, dtype=np.uint64)
        self.words.view(np.uint8)[: len(packed)] = packed
        self.before = np.zeros(len(self.words), dtype=np.int64)
        np.cumsum(np.bitwise_count(self.words[:-1]), out=self.before[1:])
        self.ones = int(bits.sum())

    def rank1(self, i: np.ndarray) -> np.ndarray:
        w = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[w] + np.bitwise_count(self.words[w] & mask)


class WaveletMatrix:
    def __init__(self, values: np.ndarray, sigma: int):
        self.n = len(values)
        self.levels = max(1, int(sigma - 1).bit_length())
        self.bits: list[tuple[int, BitVector, int]] = []
        x = values
        for b in range(self.levels - 1, -1, -1):
            one = (x >> b) & 1 == 1
            v = BitVector(one)
            self.bits.append((b, v, self.n - v.ones))
            x = np.concatenate([x[~one], x[one]])
        self.start = np.zeros(sigma, dtype=np.int64)
        self.start = self.place(np.arange(sigma), np.zeros(sigma, dtype=np.int64))

    def place(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        for b, v, zeros in self.bits:
            one = (c >> b) & 1
            r = v.rank1(i)
            i = np.where(one == 1, zeros + r, i - r)
        return i

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each c stands before position i."""
        return self.place(c, i) - self.start[c]


class FMIndex:
    """Index of word-id sequences; ids are 1 .. sigma - 1, 0 separates."""

    def __init__(self, ids: np.ndarray, offsets: np.ndarray, weights: np.ndarray):
        n_seg = len(offsets) - 1
        lens = np.diff(offsets)
        text = np.zeros(len(ids) + n_seg + 1, dtype=np.int64)
        shift = np.arange(1, n_seg + 1)
        where = np.arange(len(ids)) + np.repeat(shift, lens)
        text[where] = ids
        weight = np.zeros(len(text), dtype=np.int64)
        weight[where] = np.repeat(weights, lens)
        self.n = n = len(text)
        self.sigma = int(text.max()) + 1
        depth = 1
        longest = int(lens.max()) if n_seg else 1
        ranks = [text]
        while depth < longest + 1:
            r = ranks[-1]
            nxt = np.zeros(n, dtype=np.int64)
            nxt[:-depth] = r[depth:] + 1 if depth < n else 0
            _, inv = np.unique(r * np.int64(n + 2) + nxt, return_inverse=True)
            ranks.append(inv)
            depth *= 2
        sa = np.argsort(ranks[-1], kind="stable")
        self.weight_before = np.zeros(n + 1, dtype=np.int64)
        np.cumsum(weight[sa], out=self.weight_before[1:])
        self.wm = WaveletMatrix(text[sa - 1], self.sigma)
        self.first = np.zeros(self.sigma + 1, dtype=np.int64)
        np.cumsum(np.bincount(text, minlength=self.sigma), out=self.first[1:])
        self._lcp(sa, ranks, depth)

    def _lcp(self, sa: np.ndarray, ranks: list[np.ndarray], depth: int) -> None:
        n = self.n
        p, q = sa[:-1].copy(), sa[1:].copy()
        got = np.zeros(n - 1, dtype=np.int64)
        for k in range(len(ranks) - 1, -1, -1):
            step = 1 << k
            inside = (p < n) & (q < n)
            same = inside & (ranks[k][np.minimum(p, n - 1)] == ranks[k][np.minimum(q, n - 1)])
            p, q, got = p + same * step, q + same * step, got + same * step
        self.lcp = np.full(n + 1, -1, dtype=np.int64)
        self.lcp[1:n] = got
        self.smaller_left = np.zeros(n + 1, dtype=np.int64)
        self.smaller_right = np.full(n + 1, n, dtype=np.int64)
        at = np.arange(n + 1)
        for level in np.unique(got):
            here = np.flatnonzero(self.lcp == level)
            low = self.lcp < level
            self.smaller_left[here] = np.maximum.accumulate(np.where(low, at, 0))[here]
            self.smaller_right[here] = np.minimum.accumulate(np.where(low, at, n)[::-1])[::-1][here]

    def extend(self, c: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward step: the interval of c followed by each interval's match."""
        both = self.wm.rank(np.concatenate([c, c]), np.concatenate([lo, hi]))
        base = self.first[c]
        return base + both[: len(c)], base + both[len(c) :]

    def parent(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a, b = self.lcp[lo], self.lcp[hi]
        d = np.maximum(a, b)
        root = d <= 0
        up_lo = np.where(root, 0, np.where(a == d, self.smaller_left[lo], lo))
        up_hi = np.where(root, self.n, np.where(b == d, self.smaller_right[hi], hi))
        return up_lo, up_hi, np.maximum(d, 0)

    def matching_statistics(self, ids: np.ndarray, offsets: np.ndarray, least: int = 2) -> np.ndarray:
        """For each word, the length of the longest match from it on that occurs ``least`` times."""
        out = np.zeros(len(ids), dtype=np.int64)
        seg = np.argsort(-np.diff(offsets), kind="stable")
        ends, lens = offsets[1:][seg], np.diff(offsets)[seg]
        lo = np.zeros(len(seg), dtype=np.int64)
        hi = np.full(len(seg), self.n, dtype=np.int64)
        q = np.zeros(len(seg), dtype=np.int64)
        for t in range(int(lens[0]) if len(seg) else 0):
            m = int(np.searchsorted(-lens, -t, side="left"))  # segments longer than t
            at = ends[:m] - 1 - t
            todo = np.arange(m)
            while len(todo):
                nlo, nhi = self.extend(ids[at[todo]], lo[todo], hi[todo])
                good = self.weight_before[nhi] - self.weight_before[nlo] >= least
                done = todo[good]
                lo[done], hi[done] = nlo[good], nhi[good]
                q[done] += 1
                rest = todo[~good]
                todo = rest[q[rest] > 0]
                if len(todo):
                    lo[todo], hi[todo], q[todo] = self.parent(lo[todo], hi[todo])
            out[at] = q[:m]
        return out


def repeated_windows(ids: np.ndarray, offsets: np.ndarray, weights: np.ndarray, middle: np.ndarray, window: int) -> np.ndarray:
    """Bit i of a segment's mask: its window i occurs at two places or more (``middle`` is not needed here)."""
    stats = FMIndex(ids, offsets, weights).matching_statistics(ids, offsets)
    return masks(stats >= window, offsets, window)


def masks(flags: np.ndarray, offsets: np.ndarray, window: int) -> np.ndarray:
    """Flags of window starts, packed into one 64-bit mask for each segment."""
    n = len(offsets) - 1
    out = np.zeros(n, dtype=np.uint64)
    counts = np.diff(offsets) - window + 1
    for i in range(int(counts.max()) if n else 0):
        has = np.flatnonzero(counts > i)
        out[has] |= flags[offsets[has] + i].astype(np.uint64) << np.uint64(i)
    return out
