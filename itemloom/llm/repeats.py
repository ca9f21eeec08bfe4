"""Windows of words that stand at two places or more, found in shards routed by content.

Equal windows have equal minimisers, so a window can only repeat if its anchor
(the hash of its minimiser k-gram) does.  Steps, each one linear in the input:

1. every document gives its minimiser segments as small rows (no text);
2. anchors that occur once are dropped;
3. equal segments are counted and one of each fetches its text;
4. segments are dealt to shards by anchor, and each shard's matcher
   (FM-index or sparse suffix array) says which windows repeat;
5. the answers return to all segments, then to the documents.

A large group of copies is one counted segment after step 3.  An anchor with
very many different segments (a common passage in many contexts) is split:
each of its windows is routed by its own hash.  No step gathers pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .skew import HEAVY, spread_join
from .staging import Staged
from .words import Words, anchors, chunks, mix, text_buffers, windows_hash

#: Words in the index of one shard; a shard is cut only between anchors.
SHARD_WORDS = 400_000
#: An anchor with more different segments is routed window by window.
SPREAD = 4_000
#: Places of one window that a task remembers before it answers them.
PLACES = 4_096


def keyed(docs: DataFrame) -> DataFrame:
    """Row key and text: equal keys mean the same id and the same text, so repeated rows share answers."""
    return docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("k_id"),
        F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("k_text"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
    )


SEGMENT = "a long, s long, k_id long, k_text long, w0 int, n int, m int"


def segment_rows(window: int, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = text_buffers(batch.column("text"))
            ids, texts = batch.column("k_id").to_numpy(), batch.column("k_text").to_numpy()
            for lo, hi in chunks(off):
                words = Words(raw, off[lo : hi + 1])
                a, p, first, last = anchors(words, window, k)
                n = last - first + 1
                d = words.doc[first]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x) for x in (a.view(np.int64), span_hash(words, first, n + window - 1), ids[lo:hi][d], texts[lo:hi][d], (first - words.first[d]).astype(np.int32), n.astype(np.int32), (p - first).astype(np.int32))],
                    names=["a", "s", "k_id", "k_text", "w0", "n", "m"],
                )

    return run


def span_hash(words: Words, first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """A hash of each span's words, apart from the anchor's."""
    from .words import WORD_BASE, inverse, powers

    h = mix(words.hashes() ^ np.uint64(0x5851F42D4C957F2D))
    n = len(h)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(h * powers(WORD_BASE, n), out=total[1:])
    back = powers(inverse(WORD_BASE), n + 1)
    return mix((total[first + length] - total[first]) * back[first] + length.astype(np.uint64)).view(np.int64)


SPAN = "route long, a long, s long, shift int, weight long, n int, m int, words binary"


def span_texts(window: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Texts of the wanted segments; those of spread anchors as single windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["route", "a", "s", "shift", "weight", "n", "m", "words"]
        for batch in batches:
            raw, off = text_buffers(batch.column("text"))
            wanted = batch.column("wanted")
            w_off, w = wanted.offsets.to_numpy(), wanted.values
            a, s, w0, n, m, weight, spread = (w.field(i).to_numpy(zero_copy_only=False) for i in range(7))
            for lo, hi in chunks(off):
                words = Words(raw, off[lo : hi + 1])
                data = words.raw.tobytes()
                take = np.arange(w_off[lo], w_off[hi])
                d = np.repeat(np.arange(hi - lo), np.diff(w_off[lo : hi + 1]))
                begin = words.first[d] + w0[take]
                wide = spread[take].astype(bool)
                if wide.any():
                    wh = windows_hash(words.hashes(), window)
                    reps = np.where(wide, n[take], 1)
                    shift = np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)
                    take, begin, wide = np.repeat(take, reps), np.repeat(begin, reps) + shift, np.repeat(wide, reps)
                    route = np.where(wide, wh[np.minimum(begin, len(wh) - 1)].view(np.int64), a[take])
                    count = np.where(wide, 1, n[take])
                else:
                    route, shift, count = a[take], np.zeros(len(take), np.int64), n[take]
                lo_b, hi_b = words.starts[begin], words.ends[begin + count + window - 2]
                spans = [data[x:y] for x, y in zip(lo_b.tolist(), hi_b.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(route), pa.array(a[take]), pa.array(s[take]), pa.array(shift.astype(np.int32)), pa.array(weight[take]), pa.array(count.astype(np.int32)), pa.array((m[take] - shift).astype(np.int32)), pa.array(spans, pa.binary())],
                    names=names,
                )

    return run


def matched(match: Callable, window: int, by_anchor: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Shards over rows sorted by route: equal word sequences of a route are one weighted segment."""

    def answer(shard: list) -> pa.RecordBatch:
        number: dict[bytes, int] = {}
        flat, lens = [], []
        for _, ws, _, _, _ in shard:
            flat += [number.setdefault(x, len(number) + 1) for x in ws]
            lens.append(len(ws))
        offsets = np.zeros(len(shard) + 1, np.int64)
        np.cumsum(lens, out=offsets[1:])
        args = (np.array(flat, np.int64), offsets, np.array([x[2] for x in shard], np.int64), np.array([x[3] for x in shard], np.int64), window)
        if by_anchor:
            found = match(*args, key=np.unique([x[0] for x in shard], return_inverse=True)[1])
        else:
            found = match(*args)
        return batch_of([(a, s, int(mask) << shift) for mask, x in zip(found.tolist(), shard, strict=True) if mask for a, s, shift in x[4]])

    def batch_of(rows: list) -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True)) or [(), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["a", "s", "mask"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard: list = []
        size, route, seen = 0, None, {}
        for batch in batches:
            col = {x: batch.column(x).to_pylist() for x in ("route", "a", "s", "shift", "weight", "m", "words")}
            for r, a, s, shift, weight, m, text in zip(*col.values(), strict=True):
                if r != route:
                    if size >= SHARD_WORDS:
                        yield answer(shard)
                        shard, size = [], 0
                    route, seen = r, {}
                ws = text.split()
                key = (m, *ws)
                if key in seen:
                    seen[key][2] += weight
                    places = seen[key][4]
                    places.append((a, s, shift))
                    if len(places) > PLACES and len(ws) == window:
                        # a single window that stands at two places is sure to be reported
                        yield batch_of([(x, y, 1 << z) for x, y, z in places])
                        places.clear()
                else:
                    seen[key] = entry = [r, ws, weight, m, [(a, s, shift)]]
                    shard.append(entry)
                    size += len(ws)
        if shard:
            yield answer(shard)

    return run


def repeated(docs: DataFrame, window: int, k: int, match: Callable, by_anchor: bool = False) -> tuple[Staged, DataFrame]:
    """(k_id, k_text, hits array<struct<w0, mask>>) of documents that hold a repeated window.

    Bit i of a mask says that the window at word w0 + i occurs at another place.
    """
    if window - k + 1 > 62:
        raise ValueError("a segment's windows must fit a 64-bit mask: window - k must be under 62")
    spark = docs.sparkSession
    staged = Staged(spark, "repeats")
    docs = keyed(docs)
    rows = staged.put(docs.mapInArrow(segment_rows(window, k), SEGMENT))
    total = rows.count()
    again = staged.put(rows.groupBy("a").agg(F.count("*").alias("c")).where("c >= 2"))
    some = staged.put(spread_join(rows, again.select("a"), ["a"], again.where(F.col("c") * HEAVY > total)))
    staged.drop(rows, again)
    each = staged.put(some.groupBy("a", "s").agg(F.count("*").alias("weight"), F.min(F.struct("k_id", "k_text", "w0", "n", "m")).alias("r")))
    spread = some.groupBy("a").agg(F.approx_count_distinct("s", 0.05).alias("c")).where(F.col("c") > SPREAD).select("a", F.lit(True).alias("spread"))
    wanted = (
        each.join(spread, "a", "left")
        .groupBy("r.k_id", "r.k_text")
        .agg(F.collect_list(F.struct("a", "s", "r.w0", "r.n", "r.m", "weight", F.coalesce("spread", F.lit(False)).alias("spread"))).alias("wanted"))
    )
    spans = (
        docs.join(wanted, ["k_id", "k_text"])
        .select("text", "wanted", "k_id", "k_text")
        .mapInArrow(first_only(span_texts(window)), SPAN)
    )
    found = (
        spans.repartition("route").sortWithinPartitions("route")
        .mapInArrow(matched(match, window, by_anchor), "a long, s long, mask long")
        .groupBy("a", "s").agg(F.bit_or("mask").alias("mask"))
    )
    found = staged.put(found)
    joined = spread_join(some, found, ["a", "s"], each.where(F.col("weight") * HEAVY > total))
    hits = joined.groupBy("k_id", "k_text").agg(F.collect_set(F.struct("w0", "mask")).alias("hits"))
    hits = staged.put(hits)
    staged.drop(some, found, each)
    return staged, hits


def first_only(inner: Callable) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Repeated rows meet in one partition; only the first of them gives its spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()

        def fresh() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keys = list(zip(batch.column("k_id").to_pylist(), batch.column("k_text").to_pylist(), strict=True))
                keep = []
                for i, x in enumerate(keys):
                    if x not in seen:
                        seen.add(x)
                        keep.append(i)
                yield batch if len(keep) == len(keys) else batch.take(pa.array(keep, pa.int64()))

        yield from inner(fresh())

    return run
