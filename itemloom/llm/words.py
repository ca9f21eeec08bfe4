"""Word tokens of whole texts as numpy arrays.

A word is a maximal run of bytes outside ``[\\x20\\x09-\\x0D]``.  Those six
bytes never occur inside a multi-byte UTF-8 sequence, so tokenising the UTF-8
bytes gives the same words as tokenising the characters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Text handled at once by the vectorised code; one document is never cut.
CHUNK_BYTES = 1 << 19
#: Odd multipliers of the polynomial hashes (fixed values, any odd number will do).
BYTE_BASE = np.uint64(0x9E3779B97F4A7C15)
WORD_BASE = np.uint64(0xC2B2AE3D27D4EB4F)

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (xor-shift and multiply)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    p = np.full(n, base, dtype=np.uint64)
    if n:
        p[0] = 1
    return np.multiply.accumulate(p) if n else p


def inverse(base: np.uint64) -> np.uint64:
    return np.uint64(pow(int(base), -1, 1 << 64))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary array; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    _, offsets, data = column.buffers()
    n = len(column)
    if offsets is None or n == 0:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    kind = np.int64 if wide else np.int32
    off = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw, off


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of whole documents of about ``limit`` bytes together."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield lo, hi
        lo = hi


class Words:
    """The words of some documents: byte ranges, document numbers, hashes."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, space: np.ndarray = _SPACE):
        base, end = int(offsets[0]), int(offsets[-1])
        self.raw = raw[base:end]
        self.offsets = offsets - base
        n = end - base
        self.n_docs = len(offsets) - 1
        solid = ~space[self.raw]
        opens = solid.copy()
        opens[1:] &= ~solid[:-1]
        closes = solid.copy()
        closes[:-1] &= ~solid[1:]
        cuts = self.offsets[1:-1]
        cuts = cuts[(cuts > 0) & (cuts < n)]
        opens[cuts] = solid[cuts]
        closes[cuts - 1] = solid[cuts - 1]
        self.starts = np.flatnonzero(opens)
        self.ends = np.flatnonzero(closes) + 1
        #: words before each document, so document d has first[d] .. first[d + 1]
        self.first = np.searchsorted(self.starts, self.offsets)
        self.doc = np.repeat(np.arange(self.n_docs), np.diff(self.first))
        self._hashes: np.ndarray | None = None

    def __len__(self) -> int:
        return len(self.starts)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes; equal words have equal hashes."""
        if self._hashes is not None:
            return self._hashes
        out = np.zeros(len(self), dtype=np.uint64)
        for lo, hi in chunks(self.offsets):
            base, end = int(self.offsets[lo]), int(self.offsets[hi])
            at = slice(int(self.first[lo]), int(self.first[hi]))
            n = end - base
            total = np.zeros(n + 1, dtype=np.uint64)
            np.cumsum((self.raw[base:end].astype(np.uint64) + np.uint64(1)) * powers(BYTE_BASE, n), out=total[1:])
            first, past = self.starts[at] - base, self.ends[at] - base
            h = (total[past] - total[first]) * powers(inverse(BYTE_BASE), n + 1)[first]
            out[at] = mix(h + (past - first).astype(np.uint64))
        self._hashes = out
        return self._hashes


def ranges(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """All whole numbers of the ranges lo[i] .. hi[i] - 1, one range after the other."""
    n = hi - lo
    return np.repeat(hi - np.cumsum(n), n) + np.arange(n.sum())


def windows_hash(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k consecutive hashes."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = h[:n].copy()
    for t in range(1, k):
        out *= WORD_BASE
        out += h[t : t + n]
    return mix(out)


def sliding_min(v: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` values, by doubling."""
    if len(v) < width:
        return v[:0]
    cur, s = v, 1
    while 2 * s <= width:
        cur = np.minimum(cur[:-s], cur[s:])
        s *= 2
    if s < width:
        cur = np.minimum(cur[: len(v) - width + 1], cur[width - s : width - s + len(v) - width + 1])
    return cur


def anchors(words: Words, window: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Minimiser segments.

    Each window of ``window`` words has one minimiser: the leftmost k-gram of
    smallest hash inside it.  Equal windows choose equal k-grams at equal
    places.  Consecutive windows with the same minimiser form a segment.
    Returns (anchor hash, minimiser's word, first window, last window), word
    positions counted over all of ``words``.
    """
    none = np.zeros(0, np.int64)
    if len(words) < window:
        return none.astype(np.uint64), none, none, none
    g = windows_hash(words.hashes(), k)
    bits = max(24, int(len(g)).bit_length())
    low = np.uint64((1 << bits) - 1)
    v = (g & ~low) | np.arange(len(g), dtype=np.uint64)
    pos = (sliding_min(v, window - k + 1) & low).astype(np.int64)
    n = len(words) - window + 1
    pos = pos[:n]
    valid = words.doc[:n] == words.doc[window - 1 :]
    at = np.flatnonzero(valid)
    if not len(at):
        return none.astype(np.uint64), none, none, none
    p = pos[at]
    new = np.ones(len(at), dtype=bool)
    new[1:] = (p[1:] != p[:-1]) | (at[1:] != at[:-1] + 1)
    begin = np.flatnonzero(new)
    last = np.append(begin[1:], len(at)) - 1
    return g[p[begin]], p[begin], at[begin], at[last]
