"""Operator 11, ranked lexical search by variable-block-max WAND.

Texts are read once: each document leaves its number of terms and the counts
of the terms that some query asks for.  Their totals give the weights.  Then
every task cuts what it scans into shards of a bounded number of postings,
indexes each (``block_max``), puts all queries to it, and keeps the best k of
each query, so only those are shuffled.

Queries go in blocks of a bounded number of terms; with more, the search runs
once for each block.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .block_max import Shard
from .staging import Staged
from .words import CHUNK_BYTES, Words, chunks, text_buffers

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Terms of a block of queries, about; they and the queries are broadcast.
QUERY_TERMS = 1 << 18
#: Postings of a shard, about.
SHARD_POSTINGS = 1 << 21

_LOWER_BYTE = np.arange(256, dtype=np.uint8)
_LOWER_BYTE[ord("A") : ord("Z") + 1] += 32
_GAP = np.ones(256, dtype=bool)
_GAP[128:] = False
_GAP[[ord(c) for c in _UPPER + _LOWER + "0123456789"]] = False


def terms_of(text: Column) -> Column:
    """Different terms of a text."""
    low = F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)
    return F.array_distinct(F.regexp_extract_all(low, F.lit(TERM), F.lit(0)))


def pieces(raw: np.ndarray, off: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, Words]]:
    """(first document, words) of stretches of about ``limit`` bytes; a longer document is cut between its words."""
    for lo, hi in chunks(off, limit):
        at, end = int(off[lo]), int(off[hi])
        if end - at <= 2 * limit:
            yield lo, Words(_LOWER_BYTE[raw[at:end]], off[lo : hi + 1] - at, _GAP)
            continue
        while at < end:
            to = at + limit
            while to < end and not _GAP[raw[to : to + 64]].any():
                to += 64
            to = min(end, to + int(_GAP[raw[to : to + 64]].argmax())) if to < end else end
            yield lo, Words(_LOWER_BYTE[raw[at:to]], np.array([0, to - at]), _GAP)
            at = to


class Vocabulary:
    """The terms of a block of queries, told apart by 64-bit hash and length."""

    def __init__(self, terms: list[str]):
        raw, off = text_buffers(pa.array(terms, pa.large_string()))
        words = Words(raw, off, _GAP)
        order = np.argsort(words.hashes(), kind="stable")
        self.hash, self.number = words.hashes()[order], order
        self.size = (words.ends - words.starts)[order]

    def count(self, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(terms of each document; document, term and occurrences of what the queries ask for), by document and term."""
        n, width = np.zeros(len(off) - 1, np.int64), max(1, len(self.hash))
        keys, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for first, words in pieces(raw, off):
            n[first : first + words.n_docs] += np.diff(words.first)
            if not len(self.hash) or not len(words):
                continue
            h = words.hashes()
            at = np.minimum(np.searchsorted(self.hash, h), len(self.hash) - 1)
            hit = np.flatnonzero((self.hash[at] == h) & (self.size[at] == words.ends - words.starts))
            key, count = np.unique((words.doc[hit] + first) * width + self.number[at[hit]], return_counts=True)
            keys.append(key)
            counts.append(count)
        key, back = np.unique(np.concatenate(keys), return_inverse=True)
        return n, key // width, key % width, np.bincount(back, np.concatenate(counts), len(key)).astype(np.int64)


def counted(vocabulary) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = text_buffers(batch.column("text"))
            n, doc, term, tf = vocabulary.value.count(raw, off)
            cut = pa.array(np.searchsorted(doc, np.arange(len(n) + 1)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(cut, pa.array(x.astype(np.int32))) for x in (term, tf)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n), *lists], names=["doc_id", "n", "terms", "tfs"])

    return run


def weights(n: int, df: np.ndarray) -> np.ndarray:
    """floor(1000 ln((2N + 2) / (2 df + 1))) of each term."""
    return np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * d + 1))) for d in df.tolist()], dtype=np.int64)


class Best:
    """The best k (score, doc_id) of each query so far; ties go to the smaller doc_id, a null one last."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.kept: list[tuple[np.ndarray, np.ndarray, np.ndarray] | None] = [None] * queries

    def least(self, query: int) -> float:
        kept = self.kept[query]
        return float(kept[0][-1]) if kept is not None and len(kept[0]) == self.k else 1.0

    def add(self, query: int, score: np.ndarray, ids: np.ndarray, none: np.ndarray) -> None:
        if self.kept[query] is not None:
            score, ids, none = (np.concatenate(x) for x in zip(self.kept[query], (score, ids, none), strict=True))
        order = np.lexsort((ids, none, -score))[: self.k]
        self.kept[query] = score[order], ids[order], none[order]


def searched(asked, k: int, shard_postings: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Index what the task scans shard by shard, and put every query of ``asked`` to each."""

    def shard_of(held: list[pa.RecordBatch], best: Best) -> None:
        items, weight, whole, total = asked.value
        table = pa.Table.from_batches(held).combine_chunks()
        n, doc_id = table.column("n").to_numpy(), table.column("doc_id")
        order = np.argsort(n, kind="stable")  # neighbours of like length have like scores
        place = np.empty(len(n), np.int64)
        place[order] = np.arange(len(n))
        lists = table.column("terms").combine_chunks()
        size = np.diff(lists.offsets.to_numpy())
        term, tf = lists.flatten().to_numpy().astype(np.int64), table.column("tfs").combine_chunks().flatten().to_numpy().astype(np.int64)
        m = np.repeat(10 + (90 * n * whole) // max(total, 1), size)
        score = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))
        shard = Shard(len(n), np.repeat(place, size), term, score, len(weight))
        ids = doc_id.fill_null(0).to_numpy()[order]
        none = doc_id.is_null().to_numpy()[order]
        for i, (_, terms) in enumerate(items):
            docs, scores = shard.search(terms, k, best.least(i))
            if len(docs):
                best.add(i, scores, ids[docs], none[docs])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = asked.value[0]
        best, held, postings = Best(len(items), k), [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            postings += len(batch.column("terms").flatten()) + batch.num_rows
            if postings >= shard_postings:
                shard_of(held, best)
                held, postings = [], 0
        if held:
            shard_of(held, best)
        for i, kept in enumerate(best.kept):
            if kept is not None:
                score, ids, none = kept
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), i, np.int32)), pa.array(ids, mask=none), pa.array(score.astype(np.int64))], names=["item", "doc_id", "score"])

    return run


def query_blocks(queries: DataFrame, item: str, text: str, staged: Staged, most: int = QUERY_TERMS) -> Iterator[list[tuple[object, list[str]]]]:
    """Blocks of (item, its different terms); rows alike in the item's id are one item."""
    rows = queries.select(F.col(item).alias("item"), terms_of(F.col(text)).alias("terms"))
    rows = staged.put(rows.groupBy("item").agg(F.array_distinct(F.flatten(F.collect_list("terms"))).alias("terms")))
    total = rows.agg(F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()[0]
    count = max(1, -(-total // most))
    for i in range(count):
        part = rows if count == 1 else rows.where(F.pmod(F.xxhash64("item"), F.lit(count)) == i)
        yield [(r["item"], r["terms"]) for r in part.collect()]


def search(docs: DataFrame, queries: DataFrame, item: str = "item_id", text: str = "text", k: int = 10, query_terms: int = QUERY_TERMS, shard_postings: int = SHARD_POSTINGS) -> DataFrame:
    """The k best documents for each query, by the integer BM25 score of the contract.

    Returns the query's id, rank (from 1), doc_id and score, the highest score
    first, equal scores by ascending doc_id; documents that score 0 are left
    out, and a query with fewer has fewer rows.

    Null or empty texts have no terms, count for nothing and are never found;
    very long texts are counted whole, in stretches.  Repeated rows, and rows
    that share a doc_id, are documents of their own; a null doc_id ranks last
    among equal scores.  Queries that share an id (null too) are one query of
    all their terms; one without terms finds nothing.  An empty table of either
    kind gives an empty table; other columns are not read.
    """
    spark = docs.sparkSession
    staged = Staged(spark, "lexical")
    ids = queries.schema[item].dataType
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = []
    for block in query_blocks(queries, item, text, staged, query_terms):
        known = sorted({t for _, terms in block for t in terms})
        number = {t: i for i, t in enumerate(known)}
        vocabulary = spark.sparkContext.broadcast(Vocabulary(known))
        rows = staged.put(docs.mapInArrow(counted(vocabulary), "doc_id long, n long, terms array<int>, tfs array<int>"))
        whole, total = rows.agg(F.sum((F.col("n") > 0).cast("long")), F.sum("n")).first()
        df = np.zeros(len(known), np.int64)
        for r in rows.select(F.explode("terms").alias("term")).groupBy("term").count().toLocalIterator():
            df[r["term"]] = r["count"]
        items = [(i, np.array([number[t] for t in terms], np.int64)) for i, terms in block]
        asked = spark.sparkContext.broadcast((items, weights(whole or 0, df), whole or 0, total or 0))
        best = rows.where(F.size("terms") > 0).mapInArrow(searched(asked, k, shard_postings), "item int, doc_id long, score long")
        rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last()))
        best = staged.put(best.withColumn("rank", rank).where(F.col("rank") <= k))
        names = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(items)], f"item int, name {ids.simpleString()}")
        found.append(best.join(F.broadcast(names), "item").select(F.col("name").alias(item), "rank", "doc_id", "score"))  # a block's queries
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


#: The same ranking, by scoring every document.
SEARCH_SQL = rf"""
with split as (
  select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{TERM}') as terms
  from documents),
sizes as (
  select r, doc_id, len(terms)::bigint as n from split where len(terms) > 0),
whole as (
  select count(*)::bigint as n_docs, sum(n)::bigint as n_terms from sizes),
asked as (
  select distinct item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{TERM}')) as term from benchmark),
counts as (
  select r, term, count(*)::bigint as tf from (select r, unnest(terms) as term from split)
  where term in (select term from asked) group by r, term),
weighed as (
  select term, floor(1000 * ln((2 * any_value(n_docs) + 2)::double / (2 * count(*) + 1)::double))::bigint as w from counts, whole group by term),
scored as (
  select a.item_id, c.r, sum(w.w * ((1000000000 * c.tf) // (1000 * c.tf + 8 * (10 + (90 * s.n * t.n_docs) // t.n_terms))))::bigint as score
  from asked a join weighed w using (term) join counts c using (term) join sizes s using (r), whole t group by a.item_id, c.r),
ranked as (
  select item_id, row_number() over (partition by item_id order by score desc, doc_id) as rank, doc_id, score
  from scored join sizes using (r) where score > 0)
select item_id, rank::int as rank, doc_id, score from ranked where rank <= 10
"""
