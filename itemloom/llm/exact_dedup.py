"""Operator 10, exact dedup against an immutable snapshot screened by binary-fuse filters.

1. The snapshot's digests are grouped once, dealt to buckets, and each bucket's
   static binary-fuse filter is stored beside them.
2. Incoming digests are screened in the map tasks by those filters.  Digests
   that are let through (positives) and the others (negatives) are grouped
   among themselves, partial sums first: a huge group of copies is one row a task.
3. Positives join the snapshot's exact digests, and the texts behind each
   digest that both sides hold are compared byte by byte.
4. Only a digest that passed both is one group over both sides.  Negatives and
   digests whose texts differ stay groups of their own side.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .fuse_filter import BinaryFuseFilter
from .staging import Staged

WHITE = r"[\x20\x09-\x0D]+"
#: Snapshot digests in one filter, about.
BUCKET_KEYS = 50_000
#: What is sent to all executors at most; beyond it the same step is a shuffle.
BROADCAST_BYTES = 16 << 20
#: Bytes of a broadcast digest with its columns, at most.
DIGEST_BYTES = 64
#: A group above this share of all rows is heavy, so at most as many are.
HEAVY = 1_000


def normalised(text: Column) -> Column:
    """Null as empty, each run of white space as one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE, " ")


def digest_of(normal: Column) -> Column:
    """SHA-256 of a normalised text."""
    return F.unhex(F.sha2(normal, 256))


def grouped(rows: DataFrame, *by: str) -> DataFrame:
    """One row for each digest: its smallest doc_id, one row that has it, and how many rows share it."""
    nearest = F.coalesce(F.min_by("uid", "keep_id"), F.min("uid"))
    return rows.groupBy("digest", *by).agg(F.min("keep_id").alias("keep_id"), nearest.alias("uid"), F.sum("n").alias("n"))


@dataclass
class Snapshot:
    """Immutable: grouped digests and one filter for each bucket of them, both stored."""

    groups: DataFrame
    filters: DataFrame
    buckets: int
    size: int


def take_snapshot(rows: DataFrame, staged: Staged) -> Snapshot:
    groups = staged.put(grouped(rows))
    buckets = max(1, -(-groups.count() // BUCKET_KEYS))

    def build(keys: pa.Table) -> pa.Table:
        held = BinaryFuseFilter(keys.column("key").to_numpy().view(np.uint64))
        return pa.table({"bucket": keys.column("bucket").slice(0, 1), "filter": pa.array([held.to_bytes()], pa.binary())})

    keys = groups.select(F.xxhash64("digest").alias("key")).withColumn("bucket", F.pmod("key", F.lit(buckets)))
    filters = staged.put(keys.groupBy("bucket").applyInArrow(build, "bucket long, filter binary"))
    size = filters.agg(F.coalesce(F.sum(F.length("filter")), F.lit(0))).first()[0]
    return Snapshot(groups, filters, buckets, size)


def marked(filters: dict[int, BinaryFuseFilter], batch: pa.RecordBatch | pa.Table, buckets: int) -> pa.Array:
    """Which rows' keys their bucket's filter lets through."""
    key = batch.column("key").to_numpy()
    bucket = np.mod(key, buckets)
    out = np.zeros(len(key), dtype=bool)
    order = np.argsort(bucket, kind="stable")
    for b, at in zip(*split_by(bucket[order], order), strict=True):
        if b in filters:
            out[at] = filters[b].contains(key[at].view(np.uint64))
    return pa.array(out)


def split_by(values: np.ndarray, order: np.ndarray) -> tuple[list[int], list[np.ndarray]]:
    cut = np.flatnonzero(np.diff(values)) + 1
    return values[np.concatenate([[0], cut])].tolist() if len(values) else [], np.split(order, cut) if len(values) else []


def screened(incoming: DataFrame, snapshot: Snapshot) -> DataFrame:
    """Groups of the new batch, each with ``maybe``: whether the snapshot may hold its digest."""
    buckets = snapshot.buckets
    if snapshot.size <= BROADCAST_BYTES:
        stored = {r["bucket"]: bytes(r["filter"]) for r in snapshot.filters.collect()}
        sent = incoming.sparkSession.sparkContext.broadcast(stored)

        def screen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            filters = {b: BinaryFuseFilter.from_bytes(x) for b, x in sent.value.items()}
            for batch in batches:
                cols = [*(batch.column(c) for c in ("digest", "keep_id", "uid", "n")), marked(filters, batch, buckets)]
                yield pa.RecordBatch.from_arrays(cols, names=["digest", "keep_id", "uid", "n", "maybe"])

        keyed = incoming.withColumn("key", F.xxhash64("digest"))
        return grouped(keyed.mapInArrow(screen, "digest binary, keep_id long, uid long, n long, maybe boolean"), "maybe")

    def screen_bucket(left: pa.Table, right: pa.Table) -> pa.Table:
        filters = {b: BinaryFuseFilter.from_bytes(x) for b, x in zip(right.column("bucket").to_pylist(), right.column("filter").to_pylist(), strict=True)}
        return left.select(["digest", "keep_id", "uid", "n"]).append_column("maybe", marked(filters, left, buckets))

    left = grouped(incoming).withColumn("key", F.xxhash64("digest")).withColumn("bucket", F.pmod("key", F.lit(buckets)))
    cells = left.groupBy("bucket").cogroup(snapshot.filters.groupBy("bucket"))
    return cells.applyInArrow(screen_bucket, "digest binary, keep_id long, uid long, n long, maybe boolean")


def small_enough(df: DataFrame) -> DataFrame:
    """Marked for broadcast if its counted rows fit the bound; else the planner shuffles it."""
    return F.broadcast(df) if df.count() * DIGEST_BYTES <= BROADCAST_BYTES else df


def confirmed(shared: DataFrame, docs: DataFrame) -> DataFrame:
    """Of digests that both sides hold, those behind which all texts are the same bytes."""
    texts = docs.select(normalised(F.col("text")).alias("t")).withColumn("digest", digest_of(F.col("t")))
    texts = texts.join(small_enough(shared), "digest", "left_semi")
    return texts.groupBy("digest").agg(F.min("t").alias("low"), F.max("t").alias("high")).where("low = high").select("digest", F.lit(True).alias("same"))


def groups_of(docs: DataFrame, in_snapshot: Column | None, staged: Staged) -> tuple[DataFrame, DataFrame]:
    """(rows, groups): rows (digest, keep_id: own id, uid, n, old); groups (digest, old, keep_id, uid, n)."""
    old = F.coalesce(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0, F.lit(False)) if in_snapshot is None else in_snapshot
    rows = docs.select(digest_of(normalised(F.col("text"))).alias("digest"), F.col("doc_id").cast("long").alias("keep_id"), F.monotonically_increasing_id().alias("uid"), F.lit(1).cast("long").alias("n"), old.alias("old"))
    rows = staged.put(rows)
    snapshot = take_snapshot(rows.where("old"), staged)
    incoming = staged.put(screened(rows.where("not old"), snapshot))
    shared = staged.put(incoming.where("maybe").select("digest").join(snapshot.groups.select("digest"), "digest", "left_semi"))
    same = staged.put(confirmed(shared, docs))
    sides = snapshot.groups.withColumn("old", F.lit(True)).unionByName(incoming.drop("maybe").withColumn("old", F.lit(False)))
    sides = sides.join(small_enough(same), "digest", "left")
    one = grouped(sides.withColumn("side", F.when(F.col("same").isNull(), F.col("old"))), "side")
    both = F.when(F.col("side").isNull(), F.array(F.lit(True), F.lit(False))).otherwise(F.array("side"))
    groups = staged.put(one.select("digest", F.explode(both).alias("old"), "keep_id", "uid", "n"))
    staged.drop(snapshot.groups, snapshot.filters, incoming, shared, same)
    return rows, groups


def exact_dedup(docs: DataFrame, in_snapshot: Column | None = None) -> DataFrame:
    """Group equal texts; of each group the row with the smallest doc_id stays.

    ``in_snapshot`` says which rows form the snapshot that is already there
    (by default every second document by hash); the others are the new batch.
    The result does not depend on it.

    Returns one row per document: doc_id, keep_id, group_size, kept and
    text_sha256 (of the normalised text).

    A null text is an empty text; texts of white space alone equal " ".  Very
    long texts are texts like any other (their digests travel, not they).
    Rows with a null doc_id count in group_size and stay only where no row of
    the group has a doc_id (keep_id is null then).  Of repeated rows one stays.
    An empty table gives an empty table; other columns are not read.
    """
    staged = Staged(docs.sparkSession, "exact")
    rows, groups = groups_of(docs.select("doc_id", "text"), in_snapshot, staged)
    named = groups.select("digest", "old", F.col("keep_id").alias("g_id"), F.col("uid").alias("g_uid"), F.col("n").alias("g_n"))
    out = spread_join(rows.drop("n"), named, rows.count())
    return out.select(
        F.col("keep_id").alias("doc_id"), F.col("g_id").alias("keep_id"), F.col("g_n").alias("group_size"),
        (F.col("uid") == F.col("g_uid")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"),
    )


def spread_join(rows: DataFrame, named: DataFrame, total: int) -> DataFrame:
    """Rows with their group's columns; the few heavy groups are broadcast, so no task takes a whole one."""
    on, extra = ["digest", "old"], ["g_id", "g_uid", "g_n"]
    heavy = named.where(F.col("g_n") * HEAVY > total)  # at most two rows for each of HEAVY groups
    marked_rows = rows.join(F.broadcast(heavy), on, "left")
    done = marked_rows.where("g_n is not null")
    rest = marked_rows.where("g_n is null").drop(*extra).join(named.where(F.col("g_n") * HEAVY <= total), on)
    return done.unionByName(rest)


def unique_texts(docs: DataFrame) -> DataFrame:
    """The rows that stay, columns unchanged; of wholly repeated rows one.

    Rows whose text occurs once pass without a shuffle wherever the groups of
    two or more fit a broadcast.
    """
    staged = Staged(docs.sparkSession, "unique")
    _, groups = groups_of(docs.select("doc_id", "text"), None, staged)
    several = groups.where("n > 1").select("digest", F.col("old").alias("g_old"), F.struct("keep_id").alias("keep"))
    old = F.coalesce(F.pmod(F.xxhash64(F.col("row.doc_id")), F.lit(2)) == 0, F.lit(False))
    rows = docs.select(F.struct("*").alias("row")).select("row", digest_of(normalised(F.col("row.text"))).alias("digest"), old.alias("g_old"))
    rows = rows.join(small_enough(several), ["digest", "g_old"], "left")
    once = rows.where("keep is null").select("row")
    stays = rows.where(F.col("keep").isNotNull() & F.col("row.doc_id").cast("long").eqNullSafe(F.col("keep.keep_id")))
    again = stays.groupBy("digest", "g_old", F.when(F.col("keep.keep_id").isNull(), F.lit(0)).otherwise(F.col("keep.keep_id")).alias("k")).agg(F.first("row").alias("row")).select("row")
    return once.unionByName(again).select("row.*")
