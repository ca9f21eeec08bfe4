"""Operator 3, SimHash near-dedup by meet-in-the-middle ball hashing.

Fingerprints within 3 bits of each other must be linked.  Half that radius is
1: if every fingerprint emits all its variants within 1 bit, two that differ
in 2 bits meet at a variant between them.  For the odd third bit the 64 bits
are cut into blocks, and balls are emitted once with each block left out: of
three differing bits one at least is in some block, and without it two remain.
Variants are the shuffle key; colliding fingerprints are compared in full.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components, local_forest
from .skew import HEAVY, spread_join
from .staging import Staged

RADIUS = 3
#: Groups of colliding fingerprints up to this size are compared pairwise in place; larger ones by ``ball_links``.
PAIRWISE = 4_000
#: Pairs compared at once, and links held before they are folded.
CHUNK_PAIRS = 500_000


def fingerprint(text: str | None, size: int = 3) -> int:
    """SimHash of a text's word shingles: a bit is 1 if set in over half of their XXH64 values."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    if len(words) < size:
        spans = [b" ".join(words)]
    else:
        spans = map(b" ".join, zip(*[words[i:] for i in range(size)], strict=False))
    h = np.array([xxhash.xxh64_intdigest(s, 42) for s in spans], dtype=np.uint64)
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(h), 4096):
        part = h[i : i + 4096].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(ones * 2 > len(h), bitorder="little")
    return int(bits.view(np.uint64)[0])


def fingerprint_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fp = np.array([fingerprint(t.as_py()) for t in batch.column("text")], dtype=np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("h"), pa.array(fp.view(np.int64))], names=["doc_id", "h", "fp"])


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def blocks(count: int) -> list[int]:
    """Masks of ``count`` blocks of neighbouring bits that make up the 64."""
    edge = [round(i * 64 / count) for i in range(count + 1)]
    return [((1 << (b - a)) - 1) << a for a, b in zip(edge, edge[1:], strict=False)]


def variants(fp: Column, count: int) -> Column:
    """All variants within 1 bit, with each block left out in turn; the block is told apart by a bit inside it."""
    def ball(block: int) -> Column:
        rest = fp.bitwiseAND(F.lit(signed(~block & (1 << 64) - 1))).bitwiseOR(F.lit(signed(block & -block)))
        flips = F.lit([0, *[signed(1 << j) for j in range(64) if not block >> j & 1]])
        return F.transform(flips, lambda f: rest.bitwiseXOR(f))

    return F.flatten(F.array(*[ball(b) for b in blocks(count)]))


def ball_links(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect whatever lies within 3 bits, in time linear in the group.

    Every variant within 1 bit has one owner; who shares it is within 2 bits of
    the owner.  Whoever reaches it by 2 flips is within 3.
    """
    one = [np.uint64(1) << np.uint64(i) for i in range(64)]
    inner = np.concatenate([fps, *[fps ^ b for b in one]])
    who = np.tile(np.arange(len(fps)), 65)
    centre, owner = np.unique(inner, return_index=True)
    owner = who[owner]
    a, b = [who], [owner[np.searchsorted(centre, inner)]]
    for i in range(64):
        for j in range(i):
            x = fps ^ one[i] ^ one[j]
            at = np.minimum(np.searchsorted(centre, x), len(centre) - 1)
            hit = np.flatnonzero(centre[at] == x)
            a.append(hit)
            b.append(owner[at[hit]])
    return fps[np.concatenate(a)], fps[np.concatenate(b)]


def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of one partition of (key, fp): colliding pairs, verified, as a spanning forest."""
    keys, fps = [], []
    for batch in batches:
        keys.append(batch.column("key").to_numpy())
        fps.append(batch.column("fp").to_numpy().view(np.uint64))
    if not keys:
        return
    key, fp = np.concatenate(keys), np.concatenate(fps)
    order = np.argsort(key, kind="stable")
    key, fp = key[order], fp[order]
    new = np.ones(len(key), dtype=bool)
    new[1:] = key[1:] != key[:-1]
    begin = np.flatnonzero(new)
    size = np.diff(np.append(begin, len(key)))
    found = Forest()
    for b, n in zip(begin[size > PAIRWISE].tolist(), size[size > PAIRWISE].tolist(), strict=True):
        found.add(*ball_links(np.unique(fp[b : b + n])))
    fit = (size > 1) & (size <= PAIRWISE)
    begin, size = begin[fit], size[fit]
    rank = np.argsort(-size, kind="stable")
    begin, size = begin[rank], size[rank]
    # largest groups first: those with members at distance d in the order are a prefix
    for d in range(1, int(size[0]) if len(size) else 1):
        m = int(np.searchsorted(-size, -d, side="left"))
        upto = np.cumsum(size[:m] - d)
        lo = 0
        while lo < m:
            done = int(upto[lo - 1]) if lo else 0
            hi = max(lo + 1, int(np.searchsorted(upto, done + CHUNK_PAIRS, side="right")))
            count = size[lo:hi] - d
            at = np.repeat(begin[lo:hi], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            x, y = fp[at], fp[at + d]
            near = np.bitwise_count(x ^ y) <= RADIUS
            found.add(x[near], y[near])
            lo = hi
    u, v = found.edges()
    yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])


class Forest:
    """Verified links of a partition, folded into a spanning forest whenever they become many."""

    def __init__(self) -> None:
        self.u: list[np.ndarray] = []
        self.v: list[np.ndarray] = []
        self.n = 0

    def add(self, x: np.ndarray, y: np.ndarray) -> None:
        self.u.append(x)
        self.v.append(y)
        self.n += len(x)
        if self.n > CHUNK_PAIRS:
            u, v = self.edges()
            self.u, self.v, self.n = [u], [v], len(u)
            if self.n > CHUNK_PAIRS // 2:
                self.n = 0  # the forest itself is large; wait for as many new links

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        none = np.zeros(0, np.uint64)
        return local_forest(np.concatenate([none, *self.u]), np.concatenate([none, *self.v]))


def simhash_dedup(docs: DataFrame, count: int = 3) -> DataFrame:
    """Fingerprint and near-duplicate group of every document.

    Returns doc_id, fingerprint (16 hexadecimal digits) and component_id, the
    smallest doc_id reachable over links of ``RADIUS`` differing bits or fewer.
    Documents with one fingerprint are one node, so copies cost nothing.

    A null or empty text has fingerprint zero and is linked like any other.
    Fewer than three words are one shingle.  A null doc_id stays null, and its
    row can belong to a component but never name it (a component of such rows
    alone has component_id null).  Repeated rows give repeated rows, an empty
    table an empty one; other columns are not read.
    """
    staged = Staged(docs.sparkSession, "simhash")
    rows = fingerprinted(docs, staged)
    total = rows.count()
    named = grouped(rows, staged, count)
    least = named.groupBy("root").agg(F.min("smallest").alias("component_id"), F.count("*").alias("c"))
    members = spread_join(named, least.drop("c"), ["root"], least.where(F.col("c") * HEAVY > total))
    members = staged.put(members.select("fp", "component_id", "n"))
    out = spread_join(rows.drop("h"), members.drop("n"), ["fp"], members.where(F.col("n") * HEAVY > total))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def fingerprinted(docs: DataFrame, staged: Staged) -> DataFrame:
    """(doc_id, h: hash of the text, fp) of every row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_hash().alias("h"), "text")
    return staged.put(rows.mapInArrow(fingerprint_rows, "doc_id long, h long, fp long"))


def text_hash() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def grouped(rows: DataFrame, staged: Staged, count: int) -> DataFrame:
    """One row for each fingerprint: fp, root (one for each component), smallest doc_id, n rows."""
    spark = rows.sparkSession
    nodes = staged.put(rows.groupBy("fp").agg(F.min("doc_id").alias("smallest"), F.count("*").alias("n")))
    # dealt anew, since each fingerprint becomes well over a hundred rows
    wide = int(spark.conf.get("spark.sql.shuffle.partitions"))
    balls = nodes.select("fp").repartition(wide, "fp").select("fp", F.explode(variants(F.col("fp"), count)).alias("key"))
    edges = balls.repartition("key").mapInArrow(links, "u long, v long")
    roots = connected_components(edges, staged)
    named = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "smallest", "n", F.coalesce("root", "fp").alias("root"))
    return staged.put(named)


def near_unique(docs: DataFrame, count: int = 3) -> DataFrame:
    """One row of each near-duplicate group, the one with the smallest doc_id, columns unchanged.

    Among rows that share this doc_id the smallest hash of the text decides,
    and of rows alike in both, one stays.  Rows without a doc_id can't be named
    by a group and stay.  Null, empty and very long texts are grouped as by
    ``simhash_dedup``; an empty table stays empty.
    """
    staged = Staged(docs.sparkSession, "simhash")
    rows = fingerprinted(docs, staged)
    roots = grouped(rows, staged, count).select("fp", "root")
    first = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "h"))).alias("first")
    first = rows.groupBy("fp").agg(first).join(roots, "fp").groupBy("root").agg(F.min("first").alias("first")).where("first is not null")
    keep = staged.put(first.select(F.col("first.doc_id").alias("k_id"), F.col("first.h").alias("k_h")))
    kept = docs.join(keep, (docs.doc_id == keep.k_id) & (text_hash() == keep.k_h), "left_semi")
    again = rows.join(keep, (rows.doc_id == keep.k_id) & (rows.h == keep.k_h)).groupBy("doc_id", "h").count().where("count > 1")
    if not again.isEmpty():
        row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
        kept = kept.select("doc_id", text_hash().alias("h"), row.alias("row")).groupBy("doc_id", "h").agg(F.min_by("row", F.to_json("row")).alias("row")).select("row.*")
    return kept.unionByName(docs.where("doc_id is null"))
