"""Selecting items: quotas, samples, limits, anti-joins, unions (inventory L1-L4, L7, L8, J7-J13, U1-U4)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .ordinal import ranked

# Sizes of a paper and shares of the difficulties.
PER_TYPE = {"mcq": 20, "integer": 10}
PRESETS = {
    "easy": {"easy": 0.4, "medium": 0.5, "hard": 0.1},
    "medium": {"easy": 0.2, "medium": 0.6, "hard": 0.2},
    "hard": {"easy": 0.1, "medium": 0.4, "hard": 0.5},
    "balanced": {"easy": 0.33, "medium": 0.34, "hard": 0.33},
}


#: Rows of a quota table that is broadcast; a longer one is joined as Spark sees fit.
SMALL = 10_000


def quotas(spark: SparkSession, preset: str = "medium") -> DataFrame:
    """L2: (question_type, difficulty, quota); what rounding leaves over goes to medium."""
    shares = PRESETS.get(preset, PRESETS["medium"])
    rows = []
    for kind, size in PER_TYPE.items():
        whole = {d: int(size * p) for d, p in shares.items()}
        whole["medium"] += size - sum(whole.values())
        rows += [(kind, d, n) for d, n in whole.items()]
    return spark.createDataFrame(rows, "question_type string, difficulty string, quota int")


def shuffled(seed: int | str, *key: str) -> Column:
    """A reproducible shuffle: order by the md5 of seed and key."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in key]))


def quota_sample(items: DataFrame, quota: DataFrame, seed: int, key: list[str], strata: tuple[str, ...] = ("subject",), backfill: bool = False) -> DataFrame:
    """L1: per stratum the first ``quota`` items of a seeded shuffle.

    A short stratum stays short (decision B10) unless ``backfill``, which lets
    others of the same strata and type take its places.
    """
    on = ["question_type", "difficulty"]
    cells = Window.partitionBy(*strata, *on).orderBy(shuffled(seed, *key), *key)
    most, count = quota.agg(F.coalesce(F.max("quota"), F.lit(0)), F.count("*")).first()
    small = lambda df: F.broadcast(df) if count <= SMALL else df
    rows = items.join(small(quota), on).withColumn("nth", F.row_number().over(cells))
    if not backfill:
        # the literal bound lets each task drop what can't rank before anything is shuffled
        return rows.where(F.col("nth") <= int(most)).where("nth <= quota").drop("nth", "quota")
    sizes = quota.groupBy("question_type").agg(F.sum("quota").alias("size"))
    over = Window.partitionBy(*strata, "question_type").orderBy((F.col("nth") > F.col("quota")).cast("int"), shuffled(seed, *key), *key)
    rows = rows.join(small(sizes), "question_type").withColumn("place", F.row_number().over(over))
    return rows.where("place <= size").drop("nth", "quota", "place", "size")


def sample_n(items: DataFrame, n: int, seed: int, *key: str) -> DataFrame:
    """L4: n rows without replacement."""
    return items.orderBy(shuffled(seed, *key), *key).limit(n)


def head(items: DataFrame, n: int, *order: str) -> DataFrame:
    """The first n in order."""
    return items.orderBy(*order).limit(n)


def latest_file(spark: SparkSession, folder: str, glob: str) -> DataFrame:
    """The file changed last (its path and time; contents are not read)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder).select("path", "modificationTime")
    return files.orderBy(F.desc("modificationTime"), "path").limit(1)


def not_done(items: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key has not been processed."""
    return items.join(done.select(*keys).distinct(), keys, "left_anti")


def pool_without(pool: DataFrame, selected: DataFrame, keys: list[str]) -> DataFrame:
    """J10 by natural key (decision B7)."""
    return pool.join(selected, keys, "left_anti")


def replaced(selected: DataFrame, pool: DataFrame, seed: int, keys: list[str], strata: list[str]) -> DataFrame:
    """The i-th discarded row of a stratum takes the i-th spare row; without one it stays. All then count as 'rephrase'.

    Ranked inside stretches of a stratum, so none meets in one task.  A row
    without an action is kept.  ``selected`` is read twice (its rows, and its
    keys against the pool): stage it where making it twice would differ.
    """
    spare = pool_without(pool, selected, keys).select(*strata, F.struct(*[c for c in pool.columns]).alias("new"), *[F.col(k).alias(f"k{i}_") for i, k in enumerate(keys)], shuffled(f"{seed}p", *keys).alias("o_"))
    gone = F.col("action").eqNullSafe(F.lit("discard"))
    cell = F.substring("o_", 1, 3)  # 4,096 stretches of a stratum
    left = selected.withColumns({"gone_": gone, "o_": shuffled(f"{seed}d", *keys)})
    left = ranked(left, [*strata, "gone_"], cell, ["o_", *keys]).withColumn("nth", F.when(F.col("gone_"), F.col("nth"))).drop("gone_", "o_")
    right = ranked(spare, strata, cell, ["o_", *[f"k{i}_" for i in range(len(keys))]]).select(*strata, "nth", "new")
    filled = left.join(right, [*strata, "nth"], "left").withColumn("replaced", F.col("new").isNotNull())
    action = F.when(gone, F.lit("rephrase")).otherwise(F.col("action")).alias("action")
    cols = [F.coalesce(F.col("new")[c], F.col(c)).alias(c) if c in pool.columns else F.col(c) for c in selected.columns if c != "action"]
    return filled.select(*cols, action, "replaced")


def zipped(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """J12 where both sides have an ordinal or key already; ``ordinal.zip_rows`` pairs rows that have none."""
    return left.join(right, keys)


def looked_up(hits: DataFrame, store: DataFrame) -> DataFrame:
    """Documents of found ids; ids that are missing fall out."""
    return hits.join(store, "vec_id")


def union_all(*parts: DataFrame) -> DataFrame:
    """Append without deduplication, by column name."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def sources(items: DataFrame, column: str = "source_file") -> DataFrame:
    """U4."""
    return items.select(column).distinct()
