"""Chains of regular-expression rewrites as Column expressions."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_column(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


#: An edge of a word of ASCII letters, digits and '_'. Java's own \b counts letters and marks of all scripts (before version 19), though \w does not.
EDGE = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"


def rewrite(c: str | Column, rules: Iterable[tuple[str, str]], unicode: bool = False) -> Column:
    """Apply (pattern, replacement) rules in order; ``unicode`` lets \\s, \\d, \\w and \\b see all of Unicode."""
    out = as_column(c)
    for pattern, replacement in rules:
        out = F.regexp_replace(out, "(?U)" + pattern if unicode else pattern.replace(r"\b", EDGE), replacement)
    return out


def let(c: str | Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it.

    Without it an expression that names its input twice doubles with each step
    of a chain.
    """
    return F.get(F.transform(F.array(as_column(c)), lambda x: body(x)), F.lit(0))


def strip(c: str | Column, unicode: bool = True) -> Column:
    """Trim every kind of white space, not only U+0020; only the ends of a text are looked at closely."""
    return F.regexp_extract(as_column(c), ("(?sU)" if unicode else "(?s)") + r"^\s*(.*\S)", 1)


def first_group(c: str | Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match, null where there is none (or it is empty)."""
    return F.nullif(F.regexp_extract(as_column(c), pattern, group), F.lit(""))


def any_of(phrases: Iterable[str], ignore_case: bool = True) -> str:
    """One alternation of quoted phrases."""
    return ("(?i)" if ignore_case else "") + "|".join(r"\Q" + p + r"\E" for p in phrases)


def count_present(c: str | Column, words: Iterable[str]) -> Column:
    """How many different words occur in the lower-cased text."""
    low = F.lower(as_column(c))
    total = F.lit(0)
    for w in words:
        total = total + F.contains(low, F.lit(w.lower())).cast("int")
    return total


def upto_n(c: str | Column, n: int) -> Column:
    return F.left(as_column(c), F.lit(n))
