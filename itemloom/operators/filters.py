"""Predicates, dispositions and validation (inventory F1-F15, V5-V7)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rewrite import any_of, as_column
from ..functions.textnorm import JUNK_MARKERS, normalise, normalise_all, strip_junk

# Phrases that point to a figure, tokens of mathematics, subjects, difficulties.
FIGURE_PHRASES = ("in the figure", "in figure", "in the following figure", "in the diagram", "shown in figure", "shown in the figure", "circuit diagram", "given circuit", "the circuit shown", "as shown", "figure shows", "diagram shows")
FIGURE_PHRASES_SHORT = FIGURE_PHRASES[:9]
MATH_TOKENS = ("sin", "cos", "tan", "cot", "sec", "cosec", "π", "^", "theta", "θ")
SUBJECTS = ("Physics", "Chemistry", "Mathematics")
DIFFICULTIES = ("easy", "medium", "hard")
BLANK = "_____"


def needs_figure(stem: str | Column, phrases: tuple[str, ...] = FIGURE_PHRASES) -> Column:
    """F1, F2."""
    return as_column(stem).rlike(any_of(phrases))


def is_integer_type(stem: str | Column) -> Column:
    """F3, F4."""
    return F.contains(as_column(stem), F.lit(BLANK))


def good_options(options: str | Column) -> Column:
    """exactly four, none blank; null counts as none."""
    col = F.coalesce(as_column(options), F.array().cast("array<string>"))
    return (F.size(col) == 4) & F.forall(col, lambda x: F.coalesce(x.rlike(r"(?U)\S"), F.lit(False)))


def complex_math(text: str | Column, options: str | Column) -> Column:
    """some candidate of ten characters or more holds a token of mathematics."""
    all_ = F.concat(F.array(as_column(text)), F.coalesce(as_column(options), F.array().cast("array<string>")))
    return F.exists(all_, lambda x: (F.length(F.trim(x)) >= 10) & x.rlike(any_of(MATH_TOKENS)))


def clean_textual(text: str | Column, options: str | Column, index: str | Column) -> Column:
    """F10 as documented: after the index is known (decision B6)."""
    all_ = F.concat(F.array(as_column(text)), F.coalesce(as_column(options), F.array().cast("array<string>")))
    return as_column(index).isNotNull() & good_options(options) & ~F.exists(all_, lambda x: x.rlike(any_of(JUNK_MARKERS)))


def disposition(stem: Column, options: Column, answer: Column, keep_unanswered: bool = False) -> Column:
    """F7 (F8 with ``keep_unanswered``): why an item is kept or dropped."""
    index = answer.try_cast("int")
    integer = F.when(answer.isNotNull() | F.lit(keep_unanswered), "integer").otherwise("integer_without_answer")
    in_range = F.lit(keep_unanswered) | F.coalesce(index.between(1, 4), F.lit(False))
    mcq = F.when(~good_options(options), "bad_options").when(answer.isNull(), "mcq_without_answer").when(~in_range, "answer_out_of_range").otherwise("mcq")
    return F.when(stem == "", "empty").when(needs_figure(stem), "figure").when(is_integer_type(stem), integer).otherwise(mcq)


def clean_items(items: DataFrame, keep_unanswered: bool = False) -> DataFrame:
    """Items (question_text, options, answer_raw) normalised, cut at junk, judged and typed.

    Adds disposition, question_type, correct_index and correct_answer; drops nothing.
    """
    stem, options = strip_junk(normalise("question_text")), F.transform(normalise_all("options"), lambda x: strip_junk(x))
    out = items.withColumns({"question_text": stem, "options": options, "answer_raw": F.nullif("answer_raw", F.lit(""))})
    out = out.withColumn("disposition", disposition(F.col("question_text"), F.col("options"), F.col("answer_raw"), keep_unanswered))
    kind = F.when(F.col("disposition").isin("mcq", "integer"), F.col("disposition"))
    number = F.col("answer_raw").try_cast("int")
    return out.withColumns({"question_type": kind, "correct_index": F.when(kind == "mcq", number), "correct_answer": F.when(kind == "integer", number)})


def flagged_dataset(items: DataFrame) -> DataFrame:
    """single-paper records with their two flags."""
    index = F.col("answer_raw").try_cast("int")
    return items.withColumns({"complex_math": complex_math("question_text", "options"), "correct_index": index}).withColumn("clean_textual", clean_textual("question_text", "options", "correct_index"))


def bucketed(items: DataFrame, years: list[int] | None = None, topics: list[str] | None = None) -> DataFrame:
    """year and topic filters, then subject, type and difficulty folded to their enumerations."""
    out = items
    if years:
        out = out.where(F.col("year").isin(years))
    if topics:
        out = out.where(F.exists(F.lit(topics), lambda t: F.contains(F.lower("topic"), F.lower(t))))
    level = F.lower("difficulty")
    return out.where(F.col("subject").isin(*SUBJECTS)).withColumns({
        "question_type": F.when(F.col("question_type") == "mcq", "mcq").otherwise("integer"),
        "difficulty": F.when(level.isin(*DIFFICULTIES), level).otherwise("medium"),
    })


def unannotated(items: DataFrame, annotation: str = "ml_annotations") -> DataFrame:
    """F13."""
    return items.where(F.coalesce(F.col(annotation)["difficulty"], F.lit("")) == "")


def mcq_only(items: DataFrame) -> DataFrame:
    """F14 (sample with ``sampling.sample_n``)."""
    return items.where(F.col("question_type") == "mcq")


def with_items(papers: DataFrame) -> DataFrame:
    """F15."""
    return papers.where(F.coalesce(F.size("questions"), F.lit(0)) > 0)


def contract_errors(items: DataFrame, required: dict[str, str]) -> DataFrame:
    """V5: an ``errors`` array naming required fields that are missing or of another type."""
    checks = []
    for name, kind in required.items():
        value = F.col(name) if name in items.columns else F.lit(None)
        checks.append(F.when(value.isNull(), F.concat(F.lit(name), F.lit(" is required"))))
        checks.append(F.when(value.isNotNull() & value.cast("string").try_cast(kind).isNull(), F.concat(F.lit(name), F.lit(f" is not {kind}"))))
    return items.withColumn("errors", F.filter(F.array(*checks), lambda e: e.isNotNull()))


def quarantined(items: DataFrame, required: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """V6: (all rows with their errors, the rows that have any): invalid data is kept and reported."""
    checked = contract_errors(items, required)
    return checked, checked.where(F.size("errors") > 0)


def valid_answer_maps(answers: DataFrame, expected: int | None = None) -> DataFrame:
    """V7: per paper, whether every answer is a number (an empty map is not valid), and whether the count is as expected."""
    ok = F.bool_and(F.col("answer").try_cast("int").isNotNull() & F.col("question_number").isNotNull())
    n = F.count("question_number")
    return answers.groupBy("paper_id").agg(F.coalesce(ok & (n > 0), F.lit(False)).alias("valid"), n.alias("n"), (n == F.lit(expected) if expected is not None else F.lit(True)).alias("as_expected"))
