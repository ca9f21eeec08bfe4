"""Joins by keys of which a few may hold a large part of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key above this share of the rows is heavy, so there are at most as many heavy keys.
HEAVY = 1_000
#: Parts that a heavy key's rows are dealt to.
SALTS = 64


def spread_join(left: DataFrame, right: DataFrame, on: list[str], heavy: DataFrame) -> DataFrame:
    """``left`` joined to ``right`` (one row for each key), the rows of heavy keys dealt to ``SALTS`` tasks.

    ``heavy`` has the keys alone, at most ``HEAVY`` of them, and is broadcast.
    """
    hot = F.broadcast(heavy.select(*on, F.lit(True).alias("hot")))
    one = F.coalesce(F.col("hot"), F.lit(False))
    dealt = left.join(hot, on, "left").withColumn("salt", F.when(one, F.pmod(F.xxhash64(*left.columns), F.lit(SALTS)).cast("int")).otherwise(0)).drop("hot")
    copies = F.explode(F.when(one, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))
    many = right.join(hot, on, "left").withColumn("salt", copies).drop("hot")
    return dealt.join(many, [*on, "salt"]).drop("salt")
