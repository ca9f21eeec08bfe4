"""Mergeable sketches that are kept by batch (inventory U1, U4, A1; SURVEY 2.14).

A batch's sketch is a few kilobytes however many rows it has.  The sketch of
several batches is made from theirs, without reading a row again: distinct
values by HyperLogLog, quantiles by KLL.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Registers of the distinct count as a power of two, and its stated error: three standard deviations of 1.04 / sqrt(2 ** LOG_REGISTERS).
LOG_REGISTERS = 14
DISTINCT_ERROR = 3 * 1.04 / 2 ** (LOG_REGISTERS / 2)
#: Size of the quantile sketch, and its stated error in rank.
KLL_SIZE = 400
RANK_ERROR = 0.01
QUANTILES = (0.05, 0.25, 0.5, 0.75, 0.95)


def sketched(rows: DataFrame, by: list[str], distinct: str, number: str) -> DataFrame:
    """One row for each batch: its keys, n, and the sketches of distinct values and of a whole number's distribution (nulls count in n alone)."""
    kept = [F.count("*").alias("n"), F.hll_sketch_agg(distinct, LOG_REGISTERS).alias("distinct_sketch"), F.kll_sketch_agg_bigint(F.col(number).cast("long"), F.lit(KLL_SIZE)).alias("number_sketch")]
    return rows.groupBy(*by).agg(*kept)


def merged(sketches: DataFrame, by: list[str]) -> DataFrame:
    """The sketches of coarser batches."""
    return sketches.groupBy(*by).agg(F.sum("n").alias("n"), F.hll_union_agg("distinct_sketch").alias("distinct_sketch"), F.kll_merge_agg_bigint("number_sketch").alias("number_sketch"))


def estimated(sketches: DataFrame) -> DataFrame:
    """Adds ``distinct_estimate`` and ``quantiles`` (of ``QUANTILES``); the sketches go."""
    values = F.array(*[F.kll_sketch_get_quantile_bigint("number_sketch", F.lit(q)) for q in QUANTILES])
    return sketches.withColumns({"distinct_estimate": F.hll_sketch_estimate("distinct_sketch"), "quantiles": values}).drop("distinct_sketch", "number_sketch")


def rank_error(rows: DataFrame, by: list[str], number: str) -> DataFrame:
    """How far the true ranks of estimated quantiles (a column ``quantiles`` of ``rows``) are from the asked ones, at most: exact, in one pass.

    A value that fills a stretch of ranks is as near as its nearest rank.
    """
    q = F.col("quantiles")
    known = rows.where(F.col(number).isNotNull())
    below = [F.avg((F.col(number) < q[i]).cast("double")).alias(f"lo{i}") for i in range(len(QUANTILES))]
    upto = [F.avg((F.col(number) <= q[i]).cast("double")).alias(f"hi{i}") for i in range(len(QUANTILES))]
    off = [F.greatest(F.col(f"lo{i}") - x, F.lit(x) - F.col(f"hi{i}"), F.lit(0.0)) for i, x in enumerate(QUANTILES)]
    return known.groupBy(*by).agg(*below, *upto).select(*by, reduce(lambda a, b: F.greatest(a, b), off).alias("rank_error"))
