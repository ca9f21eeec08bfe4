"""Posting lists of one shard in blocks of variable size, and exact search that skips blocks.

Block borders are chosen list by list with dynamic programming: a block costs
its number of postings times its largest score (what its bound claims), plus a
fixed price, and the cheapest way to cut the list is taken.  So a block ends
where the next posting would loosen the bound by more than a block costs.

A search makes WAND's test, whether the bounds of the lists over a document
can reach the k-th best score, for all documents of the shard at once; blocks
over which no document passes are not read.
"""

from __future__ import annotations

import numpy as np

from .words import ranges

#: Postings of a block at most.
LONGEST = 64
#: Price of a block, in average scores of its list.
PRICE = 4.0
#: Cells of the padded tables, and lists, that are cut at once.
CELLS = 1 << 21
LISTS = 4_096


def cut(score: np.ndarray, begin: np.ndarray, longest: int = LONGEST, price: float = PRICE) -> np.ndarray:
    """Starts of all blocks of the lists ``score[begin[i] : begin[i + 1]]``, those of least cost.

    Lists of like length go through together, one posting of each at a time.
    """
    size = np.diff(begin)
    order = np.argsort(-size, kind="stable")
    order = order[: np.count_nonzero(size)]
    starts = np.zeros(len(score), dtype=bool)
    lo = 0
    while lo < len(order):
        wide = int(size[order[lo]])
        some = order[lo : lo + max(1, min(LISTS, CELLS // (wide + longest)))]
        starts[_cut_alike(score, begin[some], size[some], longest, price)] = True
        lo += len(some)
    return np.flatnonzero(starts)


def _cut_alike(score: np.ndarray, begin: np.ndarray, size: np.ndarray, longest: int, price: float) -> np.ndarray:
    """Starts of the blocks of some lists, the longest list first."""
    n, wide = len(begin), int(size[0])
    at = np.minimum(begin[:, None] + np.arange(wide)[None, :], len(score) - 1)
    held = np.arange(wide)[None, :] < size[:, None]
    x = np.zeros((n, longest + wide))
    x[:, longest:] = np.where(held, score[at], 0.0)
    each = price * x.sum(axis=1) / size
    cost = np.full((n, longest + wide + 1), np.inf)  # of the best cut of the first j postings, at longest + j
    cost[:, longest] = 0.0
    step = np.zeros((n, wide), dtype=np.uint8 if longest < 256 else np.int32)
    lengths = np.arange(1, longest + 1)
    active = np.searchsorted(-size, -np.arange(wide), side="left")  # lists with more than j postings
    for j in range(wide):
        a = int(active[j])
        largest = np.maximum.accumulate(x[:a, j + 1 : j + longest + 1][:, ::-1], axis=1)
        whole = cost[:a, j + 1 : j + longest + 1][:, ::-1] + largest * lengths
        best = whole.argmin(axis=1)
        step[:a, j] = best
        cost[:a, longest + j + 1] = whole[np.arange(a), best] + each[:a]
    out, rows, end = [], np.arange(n), size.copy()
    while len(rows):
        end = end - 1 - step[rows, end - 1]
        out.append(begin[rows] + end)
        rows, end = rows[end > 0], end[end > 0]
    return np.concatenate(out)


class Shard:
    """Posting lists over documents 0 .. n_docs - 1, scored and cut into blocks.

    ``read`` and ``held`` count the postings that searches read, and those that
    their lists hold.
    """

    def __init__(self, n_docs: int, doc: np.ndarray, term: np.ndarray, score: np.ndarray, n_terms: int, longest: int = LONGEST, price: float = PRICE):
        order = np.lexsort((doc, term))
        self.doc, self.score, self.n_docs = doc[order], score[order].astype(np.float64), n_docs
        self.begin = np.searchsorted(term[order], np.arange(n_terms + 1))
        self.block = np.append(cut(self.score, self.begin, longest, price), len(doc))
        #: blocks of list t are first[t] .. first[t + 1]
        self.first = np.searchsorted(self.block[:-1], self.begin)
        if len(doc):
            self.most = np.maximum.reduceat(self.score, self.block[:-1])
        else:
            self.most = np.zeros(0)
        self.opens, self.closes = self.doc[self.block[:-1]], self.doc[self.block[1:] - 1] + 1
        self.read = self.held = 0

    def search(self, terms: np.ndarray, k: int, least: float) -> tuple[np.ndarray, np.ndarray]:
        """(document, score) of every document above 0 that can be among the best k and scores ``least`` or more.

        More than k may come back: who ranks is decided among all shards.
        """
        own = ranges(self.first[terms], self.first[terms + 1])
        opens, closes, most = self.opens[own], self.closes[own], self.most[own]
        self.held += int((self.begin[terms + 1] - self.begin[terms]).sum())
        edge = np.bincount(opens, most, self.n_docs + 1) - np.bincount(closes, most, self.n_docs + 1)
        bound = np.cumsum(edge)[: self.n_docs]
        docs, scores, least = [np.zeros(0, np.int64)], [np.zeros(0)], max(least, 1.0)
        for width in (4 * k, 32 * k, self.n_docs):
            able = np.flatnonzero(bound >= least)
            if not len(able):
                break
            if len(able) > width:
                able = able[np.argpartition(-bound[able], width - 1)[:width]]
            got = self._exact(able, own, opens, closes)
            bound[able] = 0.0
            docs.append(able)
            scores.append(got)
            best = np.concatenate(scores)
            if len(best) >= k:
                least = max(least, float(np.partition(best, len(best) - k)[len(best) - k]))
        doc, score = np.concatenate(docs), np.concatenate(scores)
        good = score >= least
        return doc[good], score[good]

    def _exact(self, docs: np.ndarray, own: np.ndarray, opens: np.ndarray, closes: np.ndarray) -> np.ndarray:
        """Scores of some documents, from the blocks that reach over one of them."""
        asked = np.zeros(self.n_docs + 1, dtype=bool)
        asked[docs] = True
        upto = np.concatenate([[0], np.cumsum(asked)])
        live = own[upto[closes] > upto[opens]]
        at = ranges(self.block[live], self.block[live + 1])
        self.read += len(at)
        at = at[asked[self.doc[at]]]
        return np.bincount(self.doc[at], self.score[at], self.n_docs)[docs]
