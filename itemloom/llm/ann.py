"""Operator 7, approximate nearest neighbours by multi-index hashing.

Vectors become 64-bit codes: lifted so that the largest inner product is the
nearest point of a sphere, rotated by an iteratively quantised rotation learnt
on a bounded sample, and cut to signs.  Codes split into 4 substrings, each
one indexed by posting lists.  A code within Hamming radius r of a query lies
within ``r // 4`` bits of it in one of the first ``r % 4 + 1`` substrings or
within one bit less in one of the others; probing the lists of those values
retrieves every such code.  Distances are computed for what the lists hold and
for nothing else, and only codes within the radius are multiplied as floats.

The radius is each query's own, read off the sample: as wide as the codes of
the sample's vectors nearest to the query are from the query's, but no wider
than ``wanted(n)`` codes need, which grows more slowly than the table.  In
clusters it is small; structureless vectors need a wide one.

Every vector goes to one shard once; the shard's task builds its index and
then reads the queries as a stream, so memory does not grow with their number.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from .staging import Staged

BITS = 64
SUBSTRINGS = 4
#: Rows that the rotation is learnt on, and radii are read off, at most: those of smallest hash of vec_id.
SAMPLE = 4_096
#: Vectors of a shard, about, and at least where that keeps every core busy.
SHARD_ROWS = 131_072
LEAST_SHARD_ROWS = 8_192
#: Probes or posted codes looked at in one go, about.
AT_ONCE = 1 << 20

#: All values of a substring by their number of ones: the first ``_WITHIN[s]`` have at most s.
_MASKS = np.argsort(np.bitwise_count(np.arange(1 << 16, dtype=np.uint16)), kind="stable").astype(np.uint16)
_WITHIN = np.cumsum(np.bincount(np.bitwise_count(np.arange(1 << 16, dtype=np.uint16)), minlength=17))


def wanted(n: int, k: int) -> int:
    """Codes that a query's radius should hold: a part of the table that shrinks as it grows, never fewer than four times k."""
    return min(n, max(4 * k, int(1.5 * n**0.8)))


@dataclass
class Codes:
    """Lift, centre and rotate, then take signs."""

    longest: float
    centre: np.ndarray
    turn: np.ndarray

    def lifted(self, x: np.ndarray, query: bool) -> np.ndarray:
        norm2 = np.einsum("ij,ij->i", x, x)
        if query:
            return np.concatenate([x * (self.longest / np.sqrt(norm2))[:, None], np.zeros((len(x), 1))], axis=1)
        return np.concatenate([x, np.sqrt(np.maximum(self.longest**2 - norm2, 0))[:, None]], axis=1)

    def of(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        bits = (self.lifted(x, query) - self.centre) @ self.turn > 0
        return np.packbits(bits, axis=1, bitorder="little").view(np.uint64).ravel()


def learn(sample: np.ndarray, longest: float, rounds: int = 30, seed: int = 3) -> Codes:
    """Principal directions and an orthogonal turn that moves the points towards the corners of a cube."""
    codes = Codes(longest, np.zeros(sample.shape[1] + 1), np.zeros((sample.shape[1] + 1, BITS)))
    z = codes.lifted(sample, False)
    codes.centre = z.mean(axis=0)
    z = z - codes.centre
    rng = np.random.default_rng(seed)
    _, vectors = np.linalg.eigh(z.T @ z)
    main = vectors[:, ::-1][:, : min(BITS, z.shape[1])]
    flat = z @ main
    turns = []
    while sum(t.shape[1] for t in turns) < BITS:
        turn = np.linalg.qr(rng.normal(size=(flat.shape[1], flat.shape[1])))[0]
        for _ in range(rounds):
            u, _, v = np.linalg.svd(np.where(flat @ turn > 0, 1.0, -1.0).T @ flat)
            turn = v.T @ u.T
        turns.append(main @ turn)
    codes.turn = np.concatenate(turns, axis=1)[:, :BITS]
    return codes


def radii(q: np.ndarray, sample: np.ndarray, codes: Codes, n: int, k: int) -> np.ndarray:
    """Each query's radius, from a sample of the n vectors."""
    queries, held = codes.of(q, True), codes.of(sample)
    out = np.zeros(len(q), dtype=np.int32)
    need = min(len(held), max(1, -(-wanted(n, k) * len(held) // n)))
    near = min(len(held), 1 + max(8, min(k, -(-3 * k * len(held) // (2 * n)))))
    for i in range(0, len(q), 64):
        d = np.bitwise_count(queries[i : i + 64, None] ^ held[None, :])
        top = np.argpartition(-(q[i : i + 64] @ sample.T), near - 1, axis=1)[:, :near]
        wide = np.partition(d, need - 1, axis=1)[:, need - 1]
        out[i : i + 64] = np.minimum(wide, np.take_along_axis(d, top, axis=1).max(axis=1))
    return out


class MultiIndex:
    """Posting lists of code substrings; ``within`` retrieves the codes within each query's radius.

    ``compared`` counts the distances computed, which are those of posted codes.
    """

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        parts = codes.view(np.uint16).reshape(-1, SUBSTRINGS)
        self.order = [np.argsort(parts[:, j], kind="stable").astype(np.int32) for j in range(SUBSTRINGS)]
        self.begin = [np.concatenate([[0], np.cumsum(np.bincount(parts[:, j], minlength=1 << 16))]) for j in range(SUBSTRINGS)]
        self.compared = 0

    def within(self, queries: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, code) positions of all pairs within the query's radius, each pair once, by query."""
        step = radius[:, None] // SUBSTRINGS - (np.arange(SUBSTRINGS)[None, :] > radius[:, None] % SUBSTRINGS)
        step = np.minimum(step, 16)
        own = queries.view(np.uint16).reshape(-1, SUBSTRINGS)
        qs, cs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for j in range(SUBSTRINGS):
            for s in np.unique(step[:, j]).tolist():
                alike = np.flatnonzero(step[:, j] == s)
                probes = int(_WITHIN[s]) if s >= 0 else 0
                width = max(1, AT_ONCE // max(1, probes))
                for i in range(0, len(alike) if probes else 0, width):
                    for q, c in self._posted(j, alike[i : i + width], own, probes):
                        differs = queries[q] ^ self.codes[c]
                        self.compared += len(differs)
                        near = np.flatnonzero(np.bitwise_count(differs) <= radius[q])
                        q, c = q[near], c[near]
                        bits = np.bitwise_count(differs[near].view(np.uint16).reshape(-1, SUBSTRINGS)[:, :j])
                        new = ~(bits <= step[q, :j]).any(axis=1)  # an earlier substring has found the others
                        qs.append(q[new])
                        cs.append(c[new])
        q, c = np.concatenate(qs), np.concatenate(cs)
        by = np.argsort(q, kind="stable")
        return q[by], c[by]

    def _posted(self, j: int, some: np.ndarray, own: np.ndarray, probes: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, code) of what the probed lists of substring j hold, a bounded number at a time."""
        value = own[some, j][:, None] ^ _MASKS[None, :probes]
        lo, hi = self.begin[j][value].ravel(), self.begin[j][value.astype(np.int64) + 1].ravel()
        held = np.flatnonzero(hi > lo)
        lo, count, q = lo[held], (hi - lo)[held], np.repeat(some, probes)[held]
        upto = np.cumsum(count)
        i = 0
        while i < len(held):
            done = int(upto[i - 1]) if i else 0
            e = max(i + 1, int(np.searchsorted(upto, done + AT_ONCE, side="right")))
            n = count[i:e]
            at = np.arange(int(n.sum())) - np.repeat(upto[i:e] - n - done, n) + np.repeat(lo[i:e], n)
            yield np.repeat(q[i:e], n), self.order[j][at].astype(np.int64)
            i = e


RESULT = "query_id long, vec_id long, score double"


def matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


class Shard:
    """One shard's vectors and index."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, codes: Codes):
        self.ids, self.x, self.codes = ids, x, codes
        parts = [codes.of(x[i : i + 16_384].astype(np.float64)) for i in range(0, len(x), 16_384)]
        self.index = MultiIndex(np.concatenate([np.zeros(0, np.uint64), *parts]))

    def search(self, q_ids: np.ndarray, q: np.ndarray, radius: np.ndarray, k: int) -> pa.RecordBatch:
        """The shard's best k of each query among the codes within its radius."""
        out: list[list[np.ndarray]] = [[], [], []]
        at_q, at_c = self.index.within(self.codes.of(q, True), radius)
        cut = np.searchsorted(at_q, np.arange(len(q_ids) + 1))
        for i in range(len(q_ids)):
            near = at_c[cut[i] : cut[i + 1]]
            near = near[self.ids[near] != q_ids[i]]
            if not len(near):
                continue
            rough = self.x[near].astype(np.float64) @ q[i]
            n = min(k, len(near))
            edge = np.partition(rough, len(near) - n)[len(near) - n]
            near = near[rough >= edge - 1e-9 * max(1.0, abs(edge))]
            score = (self.x[near].astype(np.float64) * q[i]).sum(axis=1)
            best = np.lexsort((self.ids[near], -score))[:n]
            for col, v in zip(out, (np.full(len(best), q_ids[i]), self.ids[near][best], score[best]), strict=True):
                col.append(v)
        cols = [np.concatenate([np.zeros(0, t), *c]) for c, t in zip(out, (np.int64, np.int64, np.float64), strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["query_id", "vec_id", "score"])


def searched(codes: Codes, dim: int, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Partitions sorted by (shard, asks): a shard's vectors first, then its queries as a stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, xs, shard = None, [], [], None
        for batch in batches:
            number, asks = batch.column("shard").to_numpy(), batch.column("asks").to_numpy(zero_copy_only=False).astype(np.int8)
            cut = np.flatnonzero((np.diff(number) != 0) | (np.diff(asks) != 0)) + 1
            for lo, hi in zip([0, *cut.tolist()], [*cut.tolist(), len(number)], strict=True):
                if hi == lo:
                    continue
                if number[lo] != now:
                    now, ids, xs, shard = number[lo], [], [], None
                some, v = batch.column("vec_id").slice(lo, hi - lo).to_numpy(), matrix(batch.column("v").slice(lo, hi - lo), dim)
                if not asks[lo]:
                    ids.append(some)
                    xs.append(v)
                    continue
                radius = batch.column("radius").slice(lo, hi - lo).to_numpy().astype(np.int64)
                if shard is None and ids:
                    shard = Shard(np.concatenate(ids), np.concatenate(xs), codes)
                    ids, xs = [], []
                width = max(1, 4 * AT_ONCE // len(shard.ids)) if shard else 1
                for i in range(0, len(some) if shard else 0, width):
                    yield shard.search(some[i : i + width], v[i : i + width].astype(np.float64), radius[i : i + width], k)

    return run


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v, norm2) of vectors that take part, each different one once."""
    v = F.col("v")
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    norm = F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("v"))
    rows = rows.where(F.col("vec_id").isNotNull() & v.isNotNull()).where(whole).distinct().withColumn("norm2", norm)
    return rows.where("norm2 > 0")


def nearest(vectors: DataFrame, every: int = 20, k: int = 20, exact: bool = False) -> DataFrame:
    """The k nearest vectors by inner product of every row whose vec_id is divisible by ``every``.

    Returns query_id, rank (from 1), vec_id and score (double precision, on
    the original vectors), nearest first, ties to the smaller vec_id.

    Vectors that are null, zero or hold null or non-finite components take no
    part, nor do rows without a vec_id or of another dimension than most.  A
    vec_id that repeats is one candidate (its nearest row) and one query for
    each different vector, merged; a query is never its own neighbour.  With
    fewer than k candidates all are returned: a query whose radius held fewer
    than k is searched once more without one.  With ``exact`` no query has a
    radius, so every code is retrieved and the result is the true one.  An
    empty table gives an empty table; other columns are not read.
    """
    spark = vectors.sparkSession
    staged = Staged(spark, "ann")
    rows = staged.put(usable(vectors))
    stats = rows.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n"), F.max("norm2").alias("m"), F.sum((F.col("vec_id") % every == 0).cast("long")).alias("q"), F.count_distinct("vec_id").alias("ids")).orderBy(F.desc("n"), "dim").first()
    if stats is None or not stats["q"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim, n = stats["dim"], stats["n"]
    rows = rows.where(F.size("v") == dim).select("vec_id", "v")
    sample = matrix(rows.orderBy(F.xxhash64("vec_id"), "vec_id", F.hash("v")).limit(SAMPLE).toArrow().column("v"), dim).astype(np.float64)
    codes = learn(sample, float(np.sqrt(stats["m"])))
    shards = max(-(-n // SHARD_ROWS), min(spark.sparkContext.defaultParallelism, -(-n // LEAST_SHARD_ROWS)))
    left = rows.select("vec_id", "v", F.lit(0).alias("radius"), F.pmod(F.xxhash64("vec_id", "v"), F.lit(shards)).cast("int").alias("shard"), F.lit(False).alias("asks"))

    def with_radius(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            r = radii(matrix(batch.column("v"), dim).astype(np.float64), sample, codes, n, k)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array(r, pa.int32())], schema=batch.schema.append(pa.field("radius", pa.int32())))

    def best(asked: DataFrame) -> DataFrame:
        right = asked.select("vec_id", "v", "radius", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(True).alias("asks"))
        both = left.unionByName(right).repartition(shards, "shard").sortWithinPartitions("shard", "asks")
        found = both.mapInArrow(searched(codes, dim, k), RESULT)
        found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        return found.select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)

    asked = rows.where(F.col("vec_id") % every == 0)
    if exact:
        return best(asked.withColumn("radius", F.lit(BITS)))
    out = staged.put(best(asked.mapInArrow(with_radius, StructType([*asked.schema.fields, StructField("radius", IntegerType())]))))
    full = out.groupBy("query_id").agg(F.count("*").alias("c")).where(F.col("c") >= min(k, stats["ids"] - 1)).select(F.col("query_id").alias("vec_id"))
    short = staged.put(asked.join(full, "vec_id", "left_anti"))
    if short.isEmpty():
        return out
    return out.join(short.select(F.col("vec_id").alias("query_id")).distinct(), "query_id", "left_anti").unionByName(best(short.withColumn("radius", F.lit(BITS)))).select("query_id", "rank", "vec_id", "score")
