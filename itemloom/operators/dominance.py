"""Counting points below a corner in two dimensions, and boxes that meet, without listing a pair (inventory N36).

Both axes are cut into strips of about equally many points.  The points below
and left of a query are those of whole cells, which a table of prefix sums
has, those of the query's own column strip, and those of its own row strip in
the columns before.  Strips are counted where they are, by merge counting.

A value that many points share is a strip of its own: no point in it is below
a query of the same value, so such a strip is never gathered.

The number of boxes that meet a box follows by inclusion and exclusion from
those wholly to one side of it, and those wholly to one side in both axes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Strips of an axis at most (the table of prefix sums has the square of it), and points of a strip at least.
STRIPS = 1_024
LEAST = 4_096


def merge_counts(x: np.ndarray, y: np.ndarray, w: np.ndarray, qx: np.ndarray, qy: np.ndarray) -> np.ndarray:
    """For each query the weight of points with x < qx and y < qy.

    Points sorted by x are cut into blocks of 1, 2, 4, ... each sorted by y; a
    query's prefix is one block of each size that its length has a bit for.
    """
    order = np.argsort(x, kind="stable")
    x, y, w = x[order], y[order], w[order]
    prefix = np.searchsorted(x, qx, side="left")
    values, y = np.unique(y, return_inverse=True)
    below = np.searchsorted(values, qy, side="left")
    out, width, size = np.zeros(len(qx), np.int64), len(values) + 1, 1
    for level in range(int(len(x)).bit_length()):
        key = (np.arange(len(x)) >> level) * width + y
        by = np.argsort(key, kind="stable")
        key, total = key[by], np.concatenate([[0], np.cumsum(w[by])])
        asks = np.flatnonzero(prefix >> level & 1)
        block = (prefix[asks] >> level) - 1
        out[asks] += total[np.searchsorted(key, block * width + below[asks], side="left")] - total[block * size]
        size *= 2
    return out


def borders(points: DataFrame, value: str, strips: int) -> np.ndarray:
    """Where the strips of an axis begin (the first one has no border); a value that fills a strip has two borders around it."""
    if strips < 2:
        return np.zeros(0)
    shares = [i / strips for i in range(1, strips)]
    found = points.agg(F.percentile_approx(value, shares, 10 * strips).alias("b")).first()["b"] or []  # at most STRIPS
    edge, times = np.unique(np.array(found, dtype=np.float64), return_counts=True)
    return np.unique(np.concatenate([edge, np.nextafter(edge[times > 1], np.inf)]))


def alone(edge: np.ndarray) -> np.ndarray:
    """Of each strip, whether it holds one value only."""
    return np.concatenate([[False], np.nextafter(edge[:-1], np.inf) == edge[1:], [False]]) if len(edge) else np.array([False])


def in_strips(sent) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Adds the column strip i and the row strip j of rows with x and y."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            strip = [pa.array(np.searchsorted(edge, batch.column(c).to_numpy(), side="right").astype(np.int32)) for c, edge in zip("xy", sent.value[:2], strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *strip], names=[*batch.schema.names, "i", "j"])

    return run


def strip_counts(first: str) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Of one strip: for each query the points with a smaller ``first`` and a smaller y."""

    def run(points: pa.Table, queries: pa.Table) -> pa.Table:
        p, q = ({c: t.column(c).to_numpy() for c in (first, "y")} for t in (points, queries))
        n = merge_counts(p[first], p["y"], points.column("w").to_numpy(), q[first], q["y"]) if len(points) else np.zeros(len(queries), np.int64)
        return pa.table({"id": queries.column("id"), "both": pa.array(n)})

    return run


def strip_sides(points: pa.Table, queries: pa.Table) -> pa.Table:
    """Of one column strip: for each query the points with a smaller x, and those with a smaller y as well."""
    x, w = points.column("x").to_numpy(), points.column("w").to_numpy()
    order = np.argsort(x, kind="stable")
    total = np.concatenate([[0], np.cumsum(w[order])])
    left = total[np.searchsorted(x[order], queries.column("x").to_numpy(), side="left")]
    return strip_counts("x")(points, queries).append_column("left", pa.array(left.astype(np.int64)))


def counts_below(points: DataFrame, queries: DataFrame) -> DataFrame:
    """(id, left, both) of queries (id long, x, y): the weight of points (x, y, w long) with a smaller x, and with a smaller x and y.

    Values are doubles without nulls; ids are unique.
    """
    from ..shipping import ship

    spark = points.sparkSession
    ship(spark)
    n = points.count()
    strips = max(1, min(STRIPS, n // LEAST))
    edges = [borders(points, c, strips) for c in "xy"]
    sent = spark.sparkContext.broadcast(edges)
    p = points.select("x", "y", "w").mapInArrow(in_strips(sent), "x double, y double, w long, i int, j int")
    q = queries.select("id", "x", "y").mapInArrow(in_strips(sent), "id long, x double, y double, i int, j int")
    cells = np.zeros((len(edges[0]) + 1, len(edges[1]) + 1), np.int64)
    for r in p.groupBy("i", "j").agg(F.sum("w").alias("w")).toLocalIterator():  # at most (2 STRIPS) ** 2
        cells[r["i"], r["j"]] = r["w"]
    prefix = np.zeros((cells.shape[0] + 1, cells.shape[1] + 1), np.int64)
    prefix[1:, 1:] = cells.cumsum(axis=0).cumsum(axis=1)
    table = spark.sparkContext.broadcast(prefix)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            i, j = batch.column("i").to_numpy(), batch.column("j").to_numpy()
            cols = [batch.column("id"), pa.array(table.value[i, -1]), pa.array(table.value[i, j])]
            yield pa.RecordBatch.from_arrays(cols, names=["id", "left", "both"])

    one = [np.flatnonzero(alone(e)).tolist() for e in edges]
    many = lambda df, strip, single: df.where(~F.col(strip).isin(single)) if single else df
    cogrouped = lambda strip, single: many(p, strip, single).groupBy(strip).cogroup(many(q, strip, single).groupBy(strip))
    parts = q.mapInArrow(whole, "id long, left long, both long")
    columns = cogrouped("i", one[0]).applyInArrow(strip_sides, "id long, both long, left long")
    rows = cogrouped("j", one[1]).applyInArrow(strip_counts("i"), "id long, both long").withColumn("left", F.lit(0).cast("long"))
    return parts.unionByName(columns).unionByName(rows).groupBy("id").agg(F.sum("left").alias("left"), F.sum("both").alias("both"))


def met_by(boxes: DataFrame) -> DataFrame:
    """(id, n) of boxes (id long, x0, y0, x1, y1 double, w long): the weight of boxes that meet each one, its own included."""
    total = boxes.agg(F.coalesce(F.sum("w"), F.lit(0))).first()[0]
    n = F.lit(total).cast("long")
    # (point of the other box, corner of this one) so that "smaller in both" is wholly to one side in both axes
    sides = {"la": ("x1", "y1", "x0", "y0"), "lb": ("x1", "-y0", "x0", "-y1"), "ra": ("-x0", "y1", "-x1", "y0"), "rb": ("-x0", "-y0", "-x1", "-y1"), "al": ("y1", "x1", "y0", "x0"), "br": ("-y0", "-x0", "-y1", "-x1")}
    found = []
    for name, (px, py, qx, qy) in sides.items():
        got = counts_below(boxes.selectExpr(f"{px} as x", f"{py} as y", "w"), boxes.selectExpr("id", f"{qx} as x", f"{qy} as y"))
        single = F.col("left") if name in ("la", "ra", "al", "br") else F.lit(0)  # to the left, right, below, above
        double = F.col("both") if name in ("la", "lb", "ra", "rb") else F.lit(0)
        found.append(got.select("id", (double - single).alias("n")))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.groupBy("id").agg((n + F.sum("n")).cast("long").alias("n"))
