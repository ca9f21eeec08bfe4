"""Rendering papers (inventory G1-G4)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.latex import escape_latex
from ..functions.rewrite import as_column
from ..functions.textnorm import normalise, normalise_all
from .enrich import Provider, solutions, transform_questions
from .filters import SUBJECTS, bucketed
from .sampling import PER_TYPE, quota_sample, quotas, shuffled

HEAD = "\\documentclass{exam}\n\\usepackage{amsmath}\n\\begin{document}\n"
TAIL = "\\end{document}\n"
ROW = 10


def item_latex(text: str | Column, options: str | Column, kind: str | Column) -> Column:
    """G1: one question; the first four options of an MCQ as choices."""
    opts = as_column(options)
    lines = F.array_join(F.transform(F.slice(opts, F.lit(1), F.lit(4)), lambda o: F.concat(F.lit("  \\choice "), escape_latex(o), F.lit("\n"))), "")
    choices = F.when((as_column(kind) == "mcq") & (F.size(opts) > 0), F.concat(F.lit("\\begin{choices}\n"), lines, F.lit("\\end{choices}\n"))).otherwise("")
    return F.concat(F.lit("\\question\n"), escape_latex(text), F.lit("\n"), choices)


def numbered(selected: DataFrame, seed: int, key: list[str]) -> DataFrame:
    """One running number for body, answers and solutions alike (decisions B8, B9): subject, then MCQ before integer, then the shuffle.

    At most 20 MCQs and 10 integer items of a subject are numbered, so the
    window over the paper is bounded.
    """
    subject = F.coalesce(*[F.when(F.col("subject") == s, F.lit(i)) for i, s in enumerate(SUBJECTS)])
    part = F.when(F.col("question_type") == "mcq", 0).otherwise(1)
    most = F.when(part == 0, PER_TYPE["mcq"]).otherwise(PER_TYPE["integer"])
    nth = F.row_number().over(Window.partitionBy("subject", "question_type").orderBy(shuffled(seed, *key), *key))
    rows = selected.withColumns({"part": part, "place": subject, "nth": nth}).where(F.col("place").isNotNull() & (F.col("nth") <= most))
    return rows.withColumn("number", F.row_number().over(Window.orderBy("place", "part", "nth")))


def answer_table(listed: Column, title: str, keep) -> Column:
    """Answers of the items that ``keep`` holds for, in rows of ten."""
    some = F.filter(listed, keep)
    cells = F.transform(some, lambda x, i: F.concat(x.answer, F.when((i + 1) % ROW == 0, " \\\\\n").otherwise(" & ")))
    return F.concat(F.lit("\\section*{" + title + "}\n\\begin{tabular}{" + "l" * ROW + "}\n"), F.array_join(cells, ""), F.lit("\n\\end{tabular}\n"))


def paper_latex(rows: DataFrame, title: str = "Practice Paper") -> DataFrame:
    """Numbered items as one LaTeX document, then one answer table for MCQs and one for integers, then solutions where rows have them.

    A paper has at most 90 items (``numbered``), so one row holds it.
    """
    solution = F.col("solution") if "solution" in rows.columns else F.lit(None).cast("string")
    answer = F.coalesce(F.col("correct_index").cast("string"), F.col("correct_answer").cast("string"), F.lit("-"))
    items = rows.select("number", "subject", (F.col("part") == 0).alias("is_mcq"), item_latex("question_text", "options", "question_type").alias("latex"), F.concat(F.col("number").cast("string"), F.lit(". "), answer).alias("answer"), F.concat(F.lit("\\textbf{"), F.col("number").cast("string"), F.lit(".} "), escape_latex(solution), F.lit("\n")).alias("solution"))
    listed = F.array_sort(F.collect_list(F.struct("number", "subject", "is_mcq", "latex", "answer", "solution")))
    body = F.transform(listed, lambda x, i: F.concat(F.when((i == 0) | (F.get(listed, i - 1).subject != x.subject), F.concat(F.lit("\\section*{"), x.subject, F.lit("}\n"))).otherwise(""), x.latex))
    tables = F.concat(answer_table(listed, "Answers: multiple choice", lambda x: x.is_mcq), answer_table(listed, "Answers: integer", lambda x: ~x.is_mcq))
    worked = F.array_join(F.transform(F.filter(listed, lambda x: x.solution.isNotNull()), lambda x: x.solution), "")
    worked = F.when(worked != "", F.concat(F.lit("\\section*{Solutions}\n"), worked)).otherwise("")
    doc = F.concat(F.lit(HEAD + "\\title{" + title + "}\n\\begin{questions}\n"), F.array_join(body, ""), F.lit("\\end{questions}\n"), tables, worked, F.lit(TAIL))
    return items.agg(doc.alias("document"), F.count("*").alias("n_questions"))


def generate_paper(
    items: DataFrame, preset: str = "medium", seed: int = 0, years: list[int] | None = None, topics: list[str] | None = None, title: str = "Practice Paper",
    key: tuple[str, ...] = ("paper_id", "question_number"), solver: Provider | None = None, writer: Provider | None = None,
) -> DataFrame:
    """Filter, quota sample, rewrite (``writer``), number, solve (``solver``) and render, as one plan."""
    pool = bucketed(items, years, topics)
    chosen = quota_sample(pool, quotas(items.sparkSession, preset), seed, list(key))
    if writer is not None:
        chosen = transform_questions(chosen, pool, writer, list(key), ["subject", "question_type", "difficulty"], seed)
        number = F.col("answer_raw").try_cast("int")
        chosen = chosen.withColumns({"correct_index": F.when(F.col("question_type") == "mcq", number), "correct_answer": F.when(F.col("question_type") == "integer", number)})
    rows = numbered(chosen, seed, list(key))
    return paper_latex(solutions(rows, solver) if solver is not None else rows, title)


def preview(items: DataFrame, n: int = 5, *order: str) -> list[str]:
    """The first n items, normalised, as lines to print."""
    rows = items.orderBy(*order).limit(n).select("question_number", normalise("question_text").alias("t"), normalise_all("options").alias("o")).collect()
    return [f"Q{r['question_number']}. {r['t']}\n" + "".join(f"   ({i}) {o}\n" for i, o in enumerate(r["o"] or [], 1)) for r in rows]
