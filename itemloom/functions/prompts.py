"""Text going to and coming from external models (inventory N26-N32, N37-N39, J14)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rewrite import as_column, first_group, let, rewrite, strip


def repair_json(c: str | Column) -> Column:
    """Fences off, every lone backslash doubled (a doubled one stays)."""
    return rewrite(strip(rewrite(strip(c), [(r"(?s)^```(?:json)?", ""), (r"(?s)```$", "")])), [(r"\\\\?", r"\\\\")])


def parse_answers(c: str | Column, element: str, expected: Column) -> Column:
    """An array of the expected length, else an empty one."""
    parsed = F.from_json(repair_json(c), f"array<{element}>")
    return F.when(F.size(parsed) == expected, parsed).otherwise(F.array().cast(f"array<{element}>"))


def parse_or_repair(c: str | Column, schema: str, required: str) -> Column:
    """Parse as it is, else once more after repair; ``required`` tells a parse that worked."""
    works = lambda x, other: F.when(x[required].isNotNull(), x).otherwise(other)
    again = let(F.from_json(repair_json(c), schema), lambda x: works(x, F.lit(None)))
    return let(F.from_json(as_column(c), schema), lambda x: works(x, again))


def prompt_row(text: str | Column, options: str | Column, chars: int = 500, count: int = 4) -> Column:
    """Bounded text and options for a prompt."""
    return F.struct(F.left(as_column(text), F.lit(chars)).alias("text"), F.slice(as_column(options), F.lit(1), F.lit(count)).alias("options"))


def option_lines(options: str | Column) -> Column:
    """Numbered option lines."""
    return F.array_join(F.transform(as_column(options), lambda x, i: F.concat((i + 1).cast("string"), F.lit(") "), x)), "\n")


def answer_line(options: str | Column, index: str | Column) -> Column:
    """The correct option's number and text, where the index is in range."""
    i = as_column(index)
    text = F.try_element_at(as_column(options), F.when(i > 0, i))
    return F.coalesce(F.concat(i.cast("string"), F.lit(") "), text), i.cast("string"))


def option_digit(option_id: str | Column) -> Column:
    """N29: '2...' and 'B' both give '2'; anything else stays."""
    col = as_column(option_id)
    head = F.upper(F.left(col, F.lit(1)))
    return F.when(col.rlike(r"^\d"), F.left(col, F.lit(1))).when(head.isin("A", "B", "C", "D"), F.translate(head, "ABCD", "1234")).otherwise(col)


def letter_answer(c: str | Column) -> Column:
    """N30: 'nswer: X', then '(X)', else A."""
    return F.coalesce(first_group(c, r"[Aa]nswer[:\s]+([A-D])"), first_group(c, r"\(([A-D])\)"), F.lit("A"))


def digit_answer(c: str | Column) -> Column:
    """Null where no answer is stated."""
    return F.coalesce(first_group(c, r"(?i)(?:Answer|Correct\s*Answer)\s*[:=]?\s*\(?([1-4])\)?"), first_group(c, r"(?i)(?:Ans|Answer)\s*[:=]?\s*\(?([1-4])\)?(?:\s|\z)"))


def finish_stem(c: str | Column) -> Column:
    """A trailing cue word gives way to a colon, and a stem ends in one."""
    cut = F.regexp_replace(strip(c), r"(?U)(?:Choose|Select|Find|The\s+value|is\s+given\s+by)?\s*:?\s*\z", "")
    return F.when(strip(c) == "", F.lit("")).otherwise(F.concat(cut, F.lit(":")))


def without_empty(record: Column, fields: dict[str, str]) -> Column:
    """JSON of a struct without nulls and empty arrays; ``fields`` maps names to 'array' or 'value'."""
    kept = [F.when(F.size(record[f]) > 0, record[f]).alias(f) if kind == "array" else record[f].alias(f) for f, kind in fields.items()]
    return F.to_json(F.struct(*kept))


def model_answer(answer: str | Column, options: str | Column, kind: str | Column, original: str | Column) -> Column:
    """Letters, digits and option texts to a digit; integers to their first number, else the original."""
    a, opts = strip(as_column(answer).cast("string")), as_column(options)
    up = F.upper(a)
    at = F.filter(F.transform(opts, lambda x, i: F.when(F.contains(F.lower(x), F.lower(a)), (i + 1).cast("string"))), lambda x: x.isNotNull())
    mcq = F.when(up.isin("A", "B", "C", "D"), F.translate(up, "ABCD", "1234")).when(a.isin("1", "2", "3", "4"), a).otherwise(F.coalesce(F.try_element_at(at, F.lit(1)), as_column(original).cast("string")))
    whole = F.coalesce(first_group(a, r"(-?\d+)"), as_column(original).cast("string"))
    return F.when(as_column(kind) == "mcq", mcq).otherwise(whole)


def annotation_prompt(text: str | Column, options: str | Column) -> Column:
    """The item and its options, LaTeX first, text where there is none."""
    lines = F.array_join(F.transform(as_column(options), lambda o: F.concat(F.lit("("), o.id, F.lit(") "), F.coalesce(F.nullif(o.latex, F.lit("")), o.text, F.lit("")))), "\n")
    return F.format_string("Question: %s\nOptions:\n%s", as_column(text), lines)


def correct_text(options: str | Column, answer: str | Column) -> Column:
    """Text of the first option with the answer's id."""
    return F.try_element_at(F.filter(as_column(options), lambda o: o.id == as_column(answer)), F.lit(1)).text
