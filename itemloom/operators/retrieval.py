"""Exact nearest neighbours and context (inventory E11, L5, L6, J13, N36)."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rewrite import as_column, let
from .dominance import met_by
from .ordinal import written


def squared_distance(a: str | Column, b: str | Column) -> Column:
    """Squared Euclidean distance, summed in double precision."""
    diff = F.zip_with(as_column(a), as_column(b), lambda x, y: x.cast("double") - y.cast("double"))
    return F.aggregate(diff, F.lit(0.0), lambda s, d: s + d * d)


def nearest_to(store: DataFrame, vector: list[float], k: int = 5) -> DataFrame:
    """L5 for one query: the vector is a literal, and only k rows a partition move."""
    out = store.withColumn("d2", squared_distance("embedding", F.lit([float(x) for x in vector]).cast("array<double>")))
    return out.orderBy("d2", "vec_id").limit(k)


def best_of_cell(k: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The k nearest rows of a shard for each query of a block."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, asked = left.column("vec_id"), right.column("query_id")
        x, q = (np.stack(t.column("v").combine_chunks().to_numpy(zero_copy_only=False)) if len(t) else np.zeros((0, 0)) for t in (left, right))
        of, at, d2 = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        if len(x) and len(q):
            n, order = min(k, len(x)), ids.to_numpy()
            x2, q2 = (x * x).sum(axis=1), (q * q).sum(axis=1)
            for lo in range(0, len(q), 256):
                rough = x2[None, :] - 2 * (q[lo : lo + 256] @ x.T) + q2[lo : lo + 256, None]
                edge = np.partition(rough, n - 1, axis=1)[:, n - 1] + 1e-9 * (x2.max() + q2[lo : lo + 256])
                for i in range(len(rough)):
                    near = np.flatnonzero(rough[i] <= edge[i])
                    # in the order of the components, as squared_distance adds
                    exact = np.add.accumulate((x[near] - q[lo + i]) ** 2, axis=1)[:, -1]
                    best = np.lexsort((order[near], exact))[:n]
                    of.append(np.full(n, lo + i))
                    at.append(near[best])
                    d2.append(exact[best])
        return pa.table({"query_id": asked.take(pa.array(np.concatenate(of))), "vec_id": ids.take(pa.array(np.concatenate(at))), "d2": np.concatenate(d2)})

    return run


#: Vectors that pivots are taken from and first bounds are read off, those of smallest hash, and pivots among them, at most.
SAMPLE = 4_096
PIVOTS = 128


@dataclass
class Pivots:
    """Sampled vectors by dimension; the first of them are pivots, around which the vectors are sharded."""

    sample: dict[int, np.ndarray]

    def of(self, dim: int) -> np.ndarray:
        held = self.sample.get(dim)
        return held[: min(PIVOTS, max(1, len(held) // 8))] if held is not None else np.zeros((0, dim))

    @staticmethod
    def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        d2 = (x * x).sum(axis=1)[:, None] - 2 * (x @ y.T) + (y * y).sum(axis=1)[None, :]
        return np.sqrt(np.maximum(d2, 0))

    def placed(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(nearest pivot, distance to it) of each vector."""
        d = self.distances(x, self.of(x.shape[1]))
        at = d.argmin(axis=1)
        return at.astype(np.int32), d[np.arange(len(x)), at]

    def reachable(self, q: np.ndarray, k: int, inner: np.ndarray, outer: np.ndarray) -> list[np.ndarray]:
        """For each query the pivots whose vectors (between ``inner`` and ``outer`` from the pivot) may be among its k nearest.

        The k-th distance within the sample bounds the true one from above; by
        the triangle inequality no vector of a pivot is nearer than the
        query's distance to the pivot is from its ring.
        """
        sample, pivots = self.sample[q.shape[1]], self.of(q.shape[1])
        out = []
        for lo in range(0, len(q), 256):
            some = q[lo : lo + 256]
            near = self.distances(some, sample)
            most = np.partition(near, k - 1, axis=1)[:, k - 1] if len(sample) >= k else np.full(len(some), np.inf)
            d = near[:, : len(pivots)]
            least = np.maximum(d - outer[None, :], inner[None, :] - d)
            slack = 1e-6 * (1 + d)  # distances are rounded; a shard too many costs nothing but time
            out += [np.flatnonzero(r) for r in (least <= most[:, None] + slack) & np.isfinite(outer)[None, :]]
        return out


def by_dimension(dims: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    for d in np.unique(dims).tolist():
        yield d, np.flatnonzero(dims == d)


def stacked(column: pa.Array, at: np.ndarray) -> np.ndarray:
    return np.stack(column.take(pa.array(at)).to_numpy(zero_copy_only=False))


def nearest_batch(store: DataFrame, queries: DataFrame, k: int = 5, most_queries: int = 10_000, most_rows: int = 8_192, report: dict | None = None) -> DataFrame:
    """L5 for several queries (query_id, query), however many: k nearest of each, with d2 and rank.

    Vectors are sharded around pivots, and a query goes to those shards alone
    that can hold one of its k nearest (exactly: what is left out is proven to
    be farther).  Shards of more than about ``most_rows`` vectors are split,
    queries go in blocks of about ``most_queries``.  ``report`` gets the number
    of ``shards``, and of visits that were ``possible`` and ``made``.

    Vectors meet queries of the same dimension; those that are null or empty or
    hold null or non-finite components have no distance and take no part.
    """
    from ..shipping import ship

    spark = store.sparkSession
    ship(spark)

    def usable(df: DataFrame, key: str, vector: str) -> DataFrame:
        rows = df.select(key, F.col(vector).cast("array<double>").alias("v")).where(F.size("v") > 0)
        return rows.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))).withColumn("dim", F.size("v"))

    rows, asked = usable(store, "vec_id", "embedding"), usable(queries, "query_id", "query")
    sample: dict[int, list] = {}
    for r in rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("v").collect():
        sample.setdefault(len(r["v"]), []).append(r["v"])
    sent = spark.sparkContext.broadcast(Pivots({d: np.array(v) for d, v in sample.items()}))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pivot, away = np.full(batch.num_rows, -1, np.int32), np.zeros(batch.num_rows)
            for d, at in by_dimension(batch.column("dim").to_numpy()):
                if d in sent.value.sample:
                    pivot[at], away[at] = sent.value.placed(stacked(batch.column("v"), at))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pivot), pa.array(away)], names=[*batch.schema.names, "pivot", "away"])

    kinds = [store.schema["vec_id"].dataType.simpleString(), queries.schema["query_id"].dataType.simpleString()]
    placed = written(rows.mapInArrow(place, f"vec_id {kinds[0]}, v array<double>, dim int, pivot int, away double"), "placed")
    shards = placed.groupBy("dim", "pivot").agg(F.count("*").alias("n"), F.min("away").alias("inner"), F.max("away").alias("outer")).collect()  # PIVOTS for each dimension
    known = {(r["dim"], r["pivot"]): r for r in shards}
    parts = {key: max(1, -(-r["n"] // most_rows)) for key, r in known.items()}
    table = spark.sparkContext.broadcast((known, parts))

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each query and shard that it must see."""
        known, parts = table.value
        for batch in batches:
            of, to = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
            for d, at in by_dimension(batch.column("dim").to_numpy()):
                rest = [(-1, np.arange(len(at)))] if (d, -1) in known else []
                if d in sent.value.sample:
                    count = len(sent.value.of(d))
                    ring = np.array([(known[d, p]["inner"], known[d, p]["outer"]) if (d, p) in known else (0, np.inf) for p in range(count)])
                    found = sent.value.reachable(stacked(batch.column("v"), at), k, ring[:, 0], ring[:, 1])
                    of.append(at[np.repeat(np.arange(len(at)), [len(f) for f in found])])
                    to.append(np.concatenate([*found, np.zeros(0, np.int64)]).astype(np.int32))
                for p, some in rest:
                    of.append(at[some])
                    to.append(np.full(len(some), p, np.int32))
            of, to = np.concatenate(of), np.concatenate(to)
            again = batch.take(pa.array(of))
            n = pa.array(np.array([parts[d, p] for d, p in zip(again.column("dim").to_pylist(), to.tolist(), strict=True)], np.int32))
            yield pa.RecordBatch.from_arrays([*again.columns, pa.array(to), n], names=[*again.schema.names, "pivot", "parts"])

    blocks = max(1, -(-asked.count() // most_queries))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n.cast("long") - 1))
    sizes = F.create_map(*[F.lit(x) for key, n in parts.items() if n > 1 for x in (f"{key[0]}:{key[1]}", n)]) if any(n > 1 for n in parts.values()) else F.lit(None).cast("map<string,int>")
    own = F.coalesce(sizes[F.concat_ws(":", "dim", "pivot")], F.lit(1))
    left = placed.withColumn("part", F.pmod(F.xxhash64("vec_id"), own)).withColumn("block", every(F.lit(blocks))).drop("away")
    right = asked.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks))).mapInArrow(visits, f"query_id {kinds[1]}, v array<double>, dim int, block bigint, pivot int, parts int")
    if report is not None:
        total = asked.groupBy("dim").count().collect()
        report |= {"shards": len(known), "possible": sum(r["count"] * sum(d == r["dim"] for d, _ in known) for r in total), "made": right.count()}
    right = right.withColumn("part", every(F.col("parts"))).drop("parts")
    on = ["dim", "pivot", "part", "block"]
    found = left.groupBy(*on).cogroup(right.groupBy(*on)).applyInArrow(best_of_cell(k), f"query_id {kinds[1]}, vec_id {kinds[0]}, d2 double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("d2", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def context(hits: DataFrame, text: str, by: list[str], order: list[str], n: int = 3) -> DataFrame:
    """The first n texts of each group as one prompt context, with the first one's order key."""
    ranked = hits.withColumn("nth", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("nth") <= n)
    texts = F.transform(F.array_sort(F.collect_list(F.struct("nth", F.col(text).alias("t")))), lambda x: x.t)
    return ranked.groupBy(*by).agg(F.array_join(texts, "\n---\n").alias("context"), F.count("*").alias("n"))


def hashed_embedding(text: str | Column, size: int = 64) -> Column:
    """E11's offline encoder: signed hashed bag of words, unit length (stands in for a sentence model).

    Words are runs of letters and digits of any script.  A text without words,
    an empty or a null one has the zero vector.
    """
    words = F.filter(F.split(F.lower(F.coalesce(as_column(text), F.lit(""))), r"(?U)\W+"), lambda w: w != "")
    return let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: unit_bins(h, size))


def embedded(rows: DataFrame, text: str, encoder: Callable[[list[str]], list[list[float]]] | None = None, out: str = "embedding") -> DataFrame:
    """Rows with the vector of their text, from an encoder of lists of texts or, without one, by hashing."""
    if encoder is None:
        return rows.withColumn(out, hashed_embedding(text))

    @F.pandas_udf("array<float>")
    def encode(texts: pd.Series) -> pd.Series:
        return pd.Series([[float(x) for x in v] for v in encoder(texts.fillna("").tolist())], index=texts.index)

    return rows.withColumn(out, encode(F.col(text)))


def search_text(store: DataFrame, text: str, k: int = 5, encoder: Callable[[list[str]], list[list[float]]] | None = None) -> DataFrame:
    """L5, L6 for a query in words: the k rows of the store nearest to its vector, from the encoder that made the store."""
    if encoder is None:
        vector = store.sparkSession.range(1).select(hashed_embedding(F.lit(text)).alias("v")).first()["v"]
    else:
        vector = encoder([text])[0]
    return nearest_to(store, list(vector), k)


def unit_bins(h: Column, size: int) -> Column:
    """Hashes summed up by bin and sign, at unit length."""
    bins = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.aggregate(F.filter(h, lambda x: F.pmod(x, F.lit(size)) == i), F.lit(0.0), lambda s, x: s + F.when(F.pmod(F.shiftright(x, 8), F.lit(2)) == 0, 1.0).otherwise(-1.0)))
    scaled = lambda b, norm: F.transform(b, lambda x: F.when(norm > 0, x / norm).otherwise(0.0).cast("float"))
    return let(bins, lambda b: let(F.sqrt(F.aggregate(b, F.lit(0.0), lambda s, x: s + x * x)), lambda norm: scaled(b, norm)))


def store_text(topic: str | Column, prompt: str | Column) -> Column:
    """What is embedded for an item; null counts as empty."""
    return F.concat(F.lit("Topic: "), F.coalesce(as_column(topic), F.lit("")), F.lit("\nQuestion: "), F.coalesce(as_column(prompt), F.lit("")))


def boxes_overlap(a: Column, b: Column) -> Column:
    """Closed two-dimensional intervals (x0, y0, x1, y1) that meet."""
    return ~((a.x1 < b.x0) | (b.x1 < a.x0) | (a.y1 < b.y0) | (b.y1 < a.y0))


def overlapping(boxes: DataFrame, size: float = 10.0) -> DataFrame:
    """N36 over all boxes (id, box): each pair a < b that meets, once.

    Boxes meet in the cells of a two-dimensional grid.  A pair counts only in
    the cell of its common part's lower corner, so nothing is deduplicated
    afterwards.  A box with a null bound meets none.
    """
    at = lambda v: F.floor(v / size)
    side = lambda n: F.explode(F.sequence(at(F.col(f"box.{n}0")), at(F.col(f"box.{n}1"))))
    cells = boxes.select("id", "box", side("x").alias("i")).withColumn("j", side("y"))
    pairs = cells.alias("l").join(cells.alias("r"), ["i", "j"]).where("l.id < r.id")
    low = lambda n: at(F.greatest(F.col(f"l.box.{n}0"), F.col(f"r.box.{n}0")))
    pairs = pairs.where((F.col("i") == low("x")) & (F.col("j") == low("y")))
    return pairs.where(boxes_overlap(F.col("l.box"), F.col("r.box"))).select(F.col("l.id").alias("a"), F.col("r.id").alias("b"))


def overlap_counts(boxes: DataFrame) -> DataFrame:
    """(id, n): how many other boxes each box meets, 0 if none, without listing a pair (``dominance``).

    Equal boxes are one weighted box.  A box with a null or NaN bound, or with
    its bounds in the wrong order, meets none.
    """
    b = F.col("box")
    whole = F.coalesce((b.x0 <= b.x1) & (b.y0 <= b.y1) & ~F.isnan(b.x1.cast("double")) & ~F.isnan(b.y1.cast("double")), F.lit(False))
    same = written(boxes.where(whole).groupBy("box").agg(F.count("*").alias("w")).withColumn("k", F.monotonically_increasing_id()), "boxes")
    met = met_by(same.select(F.col("k").alias("id"), *[b[c].cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")], "w"))
    own = same.join(met, same.k == met.id).select(F.col("box").alias("own"), (F.col("n") - 1).alias("n"))
    return boxes.join(own, F.col("box").eqNullSafe(F.col("own")), "left").select("id", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
