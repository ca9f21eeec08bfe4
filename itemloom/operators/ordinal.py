"""Positions of rows that have no key, in two levels (inventory J12, S10b).

A row's position is the number of rows in the parts before its own, plus its
place inside the part.  Counts of parts are one small row each; the rows
themselves are neither sorted nor gathered, and no window runs over them.
They are written once, since a part must not be cut differently when it is
read again.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..shared import shared_folder

#: Bits of ``monotonically_increasing_id`` that count rows inside a part.
INSIDE = 33


def written(rows: DataFrame, name: str) -> DataFrame:
    spark = rows.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def numbered(rows: DataFrame, name: str = "nth") -> DataFrame:
    """Rows with their position (from 0) in the order that they have now: that of an ``orderBy`` before, or of the parts as they are."""
    kept = written(rows.withColumn("at_", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("at_", INSIDE)
    counts = kept.groupBy(part.alias("part_")).agg(F.count("*").alias("c_"))
    before = F.coalesce(F.sum("c_").over(Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("part_", before.alias("before_"))  # one row for each part
    inside = F.col("at_").bitwiseAND(F.lit((1 << INSIDE) - 1))
    out = kept.withColumn("part_", part).join(F.broadcast(counts), "part_")
    return out.select(*rows.columns, (F.col("before_") + inside).alias(name))


def ranked(rows: DataFrame, by: list[str], cell: Column, order: list[Column | str], name: str = "nth") -> DataFrame:
    """Rows with their position (from 0) among those of the same keys, without one task for a whole key.

    ``cell`` must grow with the order: rows are ranked inside (keys, cell), and
    the sizes of the cells before are added.  Only those sizes meet by key.
    """
    placed = rows.withColumn("cell_", cell)
    sizes = placed.groupBy(*by, "cell_").agg(F.count("*").alias("c_"))
    over = Window.partitionBy(*by).orderBy("cell_").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(*[F.col(c).alias(f"{c}_b") for c in by], F.col("cell_").alias("cell_b"), F.coalesce(F.sum("c_").over(over), F.lit(0)).alias("before_"))
    inside = F.row_number().over(Window.partitionBy(*by, "cell_").orderBy(*order)) - 1
    same = [F.col(c).eqNullSafe(F.col(f"{c}_b")) for c in by] + [F.col("cell_").eqNullSafe(F.col("cell_b"))]
    joined = placed.withColumn("inside_", inside).join(sizes, reduce(lambda a, b: a & b, same))
    return joined.select(*rows.columns, (F.col("before_") + F.col("inside_")).cast("long").alias(name))


def zip_rows(left: DataFrame, right: DataFrame, name: str = "nth") -> DataFrame:
    """The i-th row of one side beside the i-th of the other; what the longer side has left over falls out.

    Columns of the same name come from the left and, as ``right_...``, from the right.
    """
    clash = {c: f"right_{c}" for c in right.columns if c in left.columns}
    return numbered(left, name).join(numbered(right.withColumnsRenamed(clash), name), name)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line, value): every physical line of every file with its number (from 0, blank lines count).

    Large files are read in splits by many tasks; a split's lines follow those
    of the splits before it in the same file.  ``\\n`` ends a line, a ``\\r``
    before it is left out.
    """
    meta = F.col("_metadata")
    lines = spark.read.option("lineSep", "\n").text(path)
    lines = lines.select(meta["file_path"].alias("path"), meta["file_block_start"].alias("block"), F.monotonically_increasing_id().alias("at"), F.regexp_replace("value", "\r$", "").alias("value"))
    kept = written(lines, "lines")
    splits = kept.groupBy("path", "block").agg(F.min("at").alias("first"), F.count("*").alias("c"))
    order = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # the splits of one file
    splits = splits.select("path", "block", "first", F.coalesce(F.sum("c").over(order), F.lit(0)).alias("before"))
    return kept.join(splits, ["path", "block"]).select("path", (F.col("before") + F.col("at") - F.col("first")).alias("line"), "value")
