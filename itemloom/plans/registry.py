"""How queries are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from . import ORACLES, QUERIES


#: White space as Unicode names it, inside a DuckDB character class.
WHITE = r"\t\n\x0b\f\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def query(sql: str | None = None) -> Callable:
    """Register a function (tables) -> DataFrame under its name, with its SQL."""

    def keep(fn: Callable) -> Callable:
        QUERIES[fn.__name__] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return keep


class Tables:
    """The tables of a folder as attributes."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def papers(t: Tables) -> DataFrame:
    """Items built from events: a user is a paper, its events are numbered questions with a known key."""
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    rows = t.events.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("paper_id"), "event_id", "event_type", n.alias("n"))
    rows = rows.withColumn("stem", F.concat(F.lit("Find the "), "event_type", F.lit(" of item "), F.col("event_id").cast("string")))
    return rows.withColumn("answer", (F.col("event_id") % 4 + 1).cast("string")).withColumn("options", F.transform(F.lit([1, 2, 3, 4]), lambda i: F.concat(F.lit("choice "), (F.col("event_id") + i).cast("string"))))


def paper_spans(t: Tables) -> DataFrame:
    """The same items as reading-order spans."""
    rows = papers(t)
    head = [F.concat(F.lit("Q"), F.col("n").cast("string"), F.lit(".")), F.col("stem")]
    opts = [x for i in range(4) for x in (F.lit(f"({i + 1})"), F.col("options")[i])]
    spans = rows.select("paper_id", "n", F.posexplode(F.array(*head, *opts)).alias("i", "text"))
    return spans.select("paper_id", (F.col("n") * 10 + F.col("i")).cast("long").alias("pos"), F.expr("cast(n div 5 + 1 as int)").alias("page"), "text")


#: The same items in SQL.
PAPERS = """
papers as (
  select 'u' || user_id as paper_id, event_id, event_type, n,
         'Find the ' || event_type || ' of item ' || event_id as stem,
         (event_id % 4 + 1)::varchar as answer,
         'choice ' || (event_id + 1) as o1, 'choice ' || (event_id + 2) as o2,
         'choice ' || (event_id + 3) as o3, 'choice ' || (event_id + 4) as o4
  from (select *, row_number() over (partition by user_id order by event_id) as n from events))
"""
