"""Metadata from names (inventory N13-N16)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rewrite import as_column, first_group


def paper_metadata(name: str | Column) -> Column:
    """struct(paper_id, year, date, shift); 0 and 'Unknown' where absent."""
    col, span = as_column(name), r"\((\d{2} \w+) Shift (\d)\)"
    found = first_group(col, span)
    return F.struct(
        col.alias("paper_id"),
        F.coalesce(first_group(col, r"JEE Main (\d{4})").try_cast("int"), F.lit(0)).alias("year"),
        F.coalesce(found, F.lit("Unknown")).alias("date"),
        F.when(found.isNotNull(), first_group(col, span, 2).try_cast("int")).otherwise(0).alias("shift"),
    )


def exam_and_shift(paper_id: str | Column) -> Column:
    """struct(exam_name, exam_date_shift) with the stated defaults."""
    col = as_column(paper_id)
    return F.struct(
        F.coalesce(first_group(col, r"(Main \d{4})"), F.lit("JEE Main 2024")).alias("exam_name"),
        F.coalesce(first_group(col, r"(\d{2}\s+\w+\s+Shift\s+\d)"), F.lit("01 Jan Shift 1")).alias("exam_date_shift"),
    )


def exam_info(filename: str | Column) -> Column:
    """N15."""
    return F.coalesce(first_group(filename, r"(\d{1,2}\s+\w+\s+(?:Shift \d)?)"), F.lit("Unknown"))


def question_id(paper_id: str | Column, number: str | Column, fallback: str = "jee_question") -> Column:
    """At most 30 safe characters of the paper's name, then the number."""
    safe = F.left(F.regexp_replace(F.translate(as_column(paper_id), " ()", "_"), "[^a-zA-Z0-9_-]", ""), F.lit(30))
    return F.concat(F.coalesce(F.nullif(safe, F.lit("")), F.lit(fallback)), F.lit("_q"), as_column(number).cast("string"))


def typed_date(date: str | Column, year: str | Column) -> Column:
    """A real date from 'DD Mon' and a year, null where it isn't one."""
    return F.try_to_timestamp(F.concat_ws(" ", as_column(date), as_column(year).cast("string")), F.lit("dd MMM yyyy")).cast("date")
