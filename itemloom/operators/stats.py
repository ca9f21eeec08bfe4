"""Statistics (inventory A1-A15)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rewrite import as_column


def rate(part: Column, whole: Column, digits: int, times: float = 100.0) -> Column:
    """A rounded share, 0 where there is nothing."""
    return F.coalesce(F.round(F.try_divide(F.lit(times) * part, whole), digits), F.lit(0.0))


def counts_by(items: DataFrame, *columns: str) -> DataFrame:
    """A1, A10: one-dimensional counts of each column and the total, in one pass (grouping sets)."""
    sets = [[c] for c in columns] + [[]]
    grouped = items.groupingSets([[F.col(c) for c in s] for s in sets], *columns)
    out = grouped.agg(F.count("*").alias("n"), F.grouping_id().alias("gid"))
    bits = {c: (1 << len(columns)) - 1 - (1 << (len(columns) - 1 - i)) for i, c in enumerate(columns)}
    name = F.coalesce(*[F.when(F.col("gid") == b, F.lit(c)) for c, b in bits.items()], F.lit("total"))
    return out.select(name.alias("dimension"), F.coalesce(*[F.col(c).cast("string") for c in columns], F.lit("")).alias("value"), "n")


def answer_coverage(items: DataFrame, answer: str = "correct_answer") -> DataFrame:
    """A2: per paper and in total, items and how many have an answer."""
    has = F.coalesce(F.col(answer) != "", F.lit(False))
    out = items.rollup("paper_id").agg(F.count("*").alias("n"), F.count_if(has).alias("with_answer"), F.grouping("paper_id").alias("is_total"))
    return out.withColumn("coverage", rate(F.col("with_answer"), F.col("n"), 1))


def dataset_stats(items: DataFrame) -> DataFrame:
    """A3: items by type, per paper and in total."""
    kinds = [F.count_if(F.col("question_type") == k).alias(k) for k in ("mcq", "integer")]
    return items.rollup("paper_id").agg(*kinds, F.count("*").alias("total"), F.grouping("paper_id").alias("is_total"))


def verification(items: DataFrame, *by: str) -> DataFrame:
    """A4, A5: three disjoint status counts (decision B11) and the verified rate."""
    n = [F.count_if(F.col("status") == s).alias(s) for s in ("verified", "mismatch", "extracted_only")]
    return items.groupBy(*by).agg(*n, F.count("*").alias("total")).withColumn("rate", rate(F.col("verified"), F.col("total"), 2))


def consolidated(items: DataFrame) -> DataFrame:
    """One row per paper with its items as an ordered array, and counts."""
    fields = [c for c in items.columns if c != "paper_id"]
    ordered = F.array_sort(F.collect_list(F.struct("question_number", *[c for c in fields if c != "question_number"])))
    return items.groupBy("paper_id").agg(F.count("*").alias("total_questions"), F.count_if(F.coalesce(F.col("status") == "verified", F.lit(False))).alias("verified"), ordered.alias("questions")).withColumn("rate", rate(F.col("verified"), F.col("total_questions"), 2))


def average_confidence(items: DataFrame, column: str = "extraction_confidence") -> DataFrame:
    """A7."""
    return items.agg(F.coalesce(F.avg(column), F.lit(0.0)).alias("overall_confidence"))


def batch_summary(results: DataFrame) -> DataFrame:
    """Results (status, duration) of a batch; nothing done counts as one for the ratios."""
    n = F.greatest(F.count("*"), F.lit(1))
    ok = F.count_if(F.col("status") == "success")
    return results.agg(F.count("*").alias("total"), ok.alias("successful"), F.count_if(F.col("status") != "success").alias("failed"), F.round(100.0 * ok / n, 2).alias("success_rate"), F.round(F.coalesce(F.sum("duration"), F.lit(0.0)) / n, 4).alias("average_duration"))


def histogram(items: DataFrame, column: str) -> DataFrame:
    """Frequencies in key order."""
    return items.groupBy(column).agg(F.count("*").alias("n")).orderBy(column)


def availability(items: DataFrame) -> DataFrame:
    """Items per subject and type over all difficulties."""
    return items.groupBy("subject", "question_type").agg(F.count("*").alias("available"))


def status_counts(results: DataFrame) -> DataFrame:
    """A12."""
    return results.groupBy("status").agg(F.count("*").alias("files"), F.coalesce(F.sum("total_questions"), F.lit(0)).alias("questions"))


def markdown_quality(text: str | Column) -> Column:
    """Counts of headings, dollars, formulas, bold question marks and garbled letters."""
    col = as_column(text)
    n = lambda p: F.regexp_count(col, F.lit(p))
    return F.struct(n("# ").alias("headings"), n(r"\$").alias("dollars"), n(r"\$[^$]+\$").alias("formulas"), n(r"\*\*Q").alias("questions"), n("�|\\(cid:|□").alias("garbled"))


def final_consolidation(items: DataFrame, extracted: DataFrame) -> DataFrame:
    """The answer key takes the place of the items' answers (J4), then one row per paper."""
    from .answers import overridden

    return consolidated(overridden(items, extracted))


def progress(done: DataFrame, totals: DataFrame, every: int = 10) -> DataFrame:
    """Done (run, nth, seconds: what this row took) against totals (run, total).

    A row for each ``every``-th and the last one of a run: rows done, elapsed
    seconds, rows a second and seconds left at that rate.
    """
    upto = Window.partitionBy("run").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    rows = done.withColumns({"n": F.count("*").over(upto), "elapsed": F.sum("seconds").over(upto)}).join(totals, "run")
    rows = rows.where((F.col("n") % every == 0) | (F.col("n") == F.col("total")))
    speed = F.try_divide(F.col("n"), F.col("elapsed"))
    return rows.select("run", "n", "elapsed", speed.alias("rate"), F.try_divide(F.col("total") - F.col("n"), speed).alias("eta"))


def observed(items: DataFrame, name: str = "progress") -> tuple[DataFrame, object]:
    """Row counts seen while a job runs, through ``Observation``."""
    from pyspark.sql import Observation

    seen = Observation(name)
    return items.observe(seen, F.count("*").alias("rows")), seen
