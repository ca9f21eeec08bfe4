"""Sparse suffix arrays: only suffixes at minimiser positions are kept.

All segments of one anchor share their minimiser k-gram.  The suffixes that
begin at it are sorted and neighbours compared (LCP); the contexts before it,
read backwards, are sorted and compared in the same way.  A window with l
words left of the minimiser repeats if another segment agrees in l words to
the left and ``window - l`` words to the right, that is if both its classes
are the same.
"""

from __future__ import annotations

import numpy as np


def padded(ids: np.ndarray, begin: np.ndarray, length: np.ndarray, width: int, step: int) -> np.ndarray:
    """One row for each context, filled with zeros; ``step`` is 1 or -1."""
    at = np.arange(width)
    inside = at[None, :] < length[:, None]
    where = np.where(inside, begin[:, None] + step * at[None, :], 0)
    return np.where(inside, ids[where], 0)


def sorted_suffixes(rows: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the contexts within their anchor, and each one's LCP with the one before (-1: other anchor)."""
    order = np.lexsort((*[rows[:, j] for j in range(rows.shape[1] - 1, -1, -1)], key))
    a, b = rows[order[:-1]], rows[order[1:]]
    differs = np.concatenate([a != b, np.ones((len(a), 1), bool)], axis=1)
    lcp = np.full(len(order), -1, dtype=np.int64)
    lcp[1:] = np.where(key[order[:-1]] == key[order[1:]], differs.argmax(axis=1), -1)
    return order, lcp


def classes(order: np.ndarray, lcp: np.ndarray, length: int) -> np.ndarray:
    """Equal numbers for contexts that agree in ``length`` words."""
    out = np.empty(len(order), dtype=np.int64)
    out[order] = np.cumsum(lcp < length)
    return out


def repeated_windows(ids: np.ndarray, offsets: np.ndarray, weights: np.ndarray, middle: np.ndarray, window: int, key: np.ndarray | None = None) -> np.ndarray:
    """Bit i of a segment's mask: its window i occurs at two places or more."""
    n = len(offsets) - 1
    out = np.zeros(n, dtype=np.uint64)
    if not n:
        return out
    key = np.zeros(n, np.int64) if key is None else key
    lens = np.diff(offsets)
    right_len, left_len = lens - middle, middle
    right = padded(ids, offsets[:-1] + middle, np.minimum(right_len, window), window, 1)
    left = padded(ids, offsets[:-1] + middle - 1, left_len, max(1, int(left_len.max())), -1)
    by_right, by_left = sorted_suffixes(right, key), sorted_suffixes(left, key)
    windows = lens - window + 1
    for l in range(int(left_len.max()) + 1):
        i = middle - l  # the window that has l words before the minimiser
        has = np.flatnonzero((i >= 0) & (i < windows))
        if not len(has):
            continue
        pair = classes(*by_left, l)[has] * np.int64(n + 2) + classes(*by_right, window - l)[has]
        _, inv = np.unique(pair, return_inverse=True)
        twice = np.bincount(inv, weights=weights[has])[inv] >= 2
        out[has] |= twice.astype(np.uint64) << i[has].astype(np.uint64)
    return out
