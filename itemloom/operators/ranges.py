"""Points in whole-number ranges, by dyadic blocks (inventory J5, J6).

A range is the union of at most two blocks of each size 1, 2, 4, ...; a point
lies in one block of each size.  So a point meets a range in exactly one of
them, and the join is an equality on (size, block): nothing is filtered or
deduplicated afterwards, and a range of a million pages is forty rows at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rewrite import as_column

LEVELS = 62
BLOCKS = "array<struct<level:int,block:bigint>>"


def blocks_of(start: str | Column, end: str | Column) -> Column:
    """The blocks that make up start .. end (both included, not negative); none if a bound is null or the range is empty."""
    lo, hi = F.greatest(as_column(start).cast("long"), F.lit(0)), as_column(end).cast("long") + 1
    one = lambda take, level, block: F.when(take, F.array(F.struct(level.cast("int").alias("level"), block.cast("long").alias("block")))).otherwise(F.array().cast(BLOCKS))

    def step(acc: Column, level: Column) -> Column:
        """The odd ends of what is left are blocks of this size; the rest is halved."""
        open_ = acc["lo"] < acc["hi"]
        left, right = open_ & (acc["lo"] % 2 == 1), open_ & (acc["hi"] % 2 == 1)
        lo, hi = acc["lo"] + F.when(left, 1).otherwise(0), acc["hi"] - F.when(right, 1).otherwise(0)
        found = F.concat(acc["found"], one(left, level, acc["lo"]), one(right & (hi >= lo), level, hi))
        return F.struct(F.shiftright(lo, 1).alias("lo"), F.shiftright(hi, 1).alias("hi"), found.alias("found"))

    begin = F.struct(lo.alias("lo"), hi.alias("hi"), F.array().cast(BLOCKS).alias("found"))
    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(hi - lo, F.lit(1)).cast("double"))).cast("int") + 1)
    found = F.aggregate(F.transform(steps, lambda i: i), begin, step, lambda acc: acc["found"])
    single = F.array(F.struct(F.lit(0).alias("level"), lo.alias("block")))  # most ranges: nothing to fold
    return F.when(lo + 1 == hi, single).when(lo < hi, found).otherwise(F.array().cast(BLOCKS))


def points_in_ranges(points: DataFrame, ranges: DataFrame, point: str, start: str, end: str, on: list[str]) -> DataFrame:
    """Each point with each range (start .. end, both included) of the same keys that holds it.

    Points are repeated for the sizes of block that occur at all: for ranges of
    a few pages two or three.  Null bounds, null points and empty ranges meet nothing.
    """
    cut = ranges.withColumn("b_", F.explode(blocks_of(start, end))).withColumns({"level_": F.col("b_.level"), "block_": F.col("b_.block")}).drop("b_")
    sizes = sorted(r[0] for r in cut.select("level_").distinct().collect())  # at most LEVELS
    at = F.explode(F.transform(F.lit(sizes).cast("array<int>"), lambda n: F.struct(n.alias("level"), F.shiftright(F.col(point).cast("long"), 0).alias("p"))))
    placed = points.where(F.col(point) >= 0).withColumn("b_", at).withColumn("level_", F.col("b_.level"))
    placed = placed.withColumn("block_", F.expr("shiftright(b_.p, b_.level)")).drop("b_")
    return placed.join(cut, [*on, "level_", "block_"]).drop("level_", "block_")
