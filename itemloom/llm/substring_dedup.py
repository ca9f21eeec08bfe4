"""Operator 1, substring dedup, and what it shares with operator 9.

The windows that repeat come from ``repeats``; here they become word intervals
and cleaned texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import fm_index
from .repeats import keyed, repeated


def covered_words(n_words: int, hits: list[dict], window: int) -> np.ndarray:
    """Which words of a document lie in a repeated window."""
    step = np.zeros(n_words + 1, dtype=np.int64)
    for hit in hits or ():
        mask, i = hit["mask"], hit["w0"]
        while mask:
            low = (mask & -mask).bit_length() - 1
            step[i + low] += 1
            step[i + low + window] -= 1
            mask &= mask - 1
    return np.cumsum(step[:-1]) > 0


def intervals(covered: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of covered words as (first, past the last)."""
    edge = np.diff(np.concatenate([[0], covered.astype(np.int8), [0]]))
    return list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True))


OUT = "doc_id long, n_words long, n_removed long, kept_sha256 string, spans array<struct<first:int,past:int>>"


def cut(window: int, with_text: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    span = pa.list_(pa.struct([("first", pa.int32()), ("past", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for text, hits in zip(batch.column("text"), batch.column("hits"), strict=True):
                words = (text.as_py() or "").encode().split()
                hits = hits.as_py()
                spans: list[tuple[int, int]] = []
                if hits:
                    covered = covered_words(len(words), hits, window)
                    spans = intervals(covered)
                    kept = [w for w, c in zip(words, covered.tolist(), strict=True) if not c]
                else:
                    kept = words
                body = b" ".join(kept)
                for col, x in zip(out, (len(words), len(words) - len(kept), hashlib.sha256(body).hexdigest(), [{"first": a, "past": b} for a, b in spans], body.decode() if with_text else None), strict=True):
                    col.append(x)
            cols = [batch.column("doc_id"), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string()), pa.array(out[3], span)]
            names = ["doc_id", "n_words", "n_removed", "kept_sha256", "spans"]
            if with_text:
                cols, names = [*cols, pa.array(out[4], pa.string())], [*names, "kept_text"]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return run


def remove_repeats(docs: DataFrame, window: int, k: int, match: Callable, by_anchor: bool, with_text: bool) -> DataFrame:
    _, hits = repeated(docs, window, k, match, by_anchor)
    whole = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("t0"))
    whole = whole.select("doc_id", "t0", F.coalesce("doc_id", F.lit(-1)).alias("k_id"), F.xxhash64(F.coalesce("t0", F.lit(""))).alias("k_text"))
    joined = whole.join(hits, ["k_id", "k_text"], "left").select("doc_id", F.coalesce("t0", F.lit("")).alias("text"), "hits")
    return joined.mapInArrow(cut(window, with_text), OUT + (", kept_text string" if with_text else ""))


def substring_dedup(docs: DataFrame, window: int = 35, k: int = 8, with_text: bool = False) -> DataFrame:
    """Remove every word covered by a window of ``window`` words that also starts elsewhere.

    Shards of content-routed segments are indexed by a compressed FM-index;
    backward search over its wavelet matrix gives the matching statistics of
    the streamed segments, and windows reaching the threshold are reported.

    Returns doc_id, n_words, n_removed, kept_sha256 (kept words joined by one
    space), spans (removed word intervals) and, if asked, kept_text.

    A null or empty text has no words: 0, 0, the hash of nothing.  A null
    doc_id stays null.  A text shorter than the window keeps all its words.
    Repeated rows each lose what they share, also if they are wholly equal.
    An empty table gives an empty table; other columns are not read.
    """
    return remove_repeats(docs, window, k, fm_index.repeated_windows, False, with_text)
