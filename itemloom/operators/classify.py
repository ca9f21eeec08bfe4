"""Keyword classifiers (inventory C1-C6), parameterised by their tables."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.rewrite import any_of, as_column, count_present

# Keyword tables.
PRIORITY_CHEMISTRY = ("molecule", "element", "atom", "compound", "reaction", "bond", "valency", "smiles", "organic", "inorganic", "chemical")
PRIORITY_PHYSICS = ("force", "velocity", "acceleration", "energy", "momentum", "wave", "field", "charge", "magnetic", "electric", "motion")
SCORE_CHEMISTRY = ("atom", "molecule", "bond", "reaction", "compound", "element", "valency", "oxidation", "pH", "acid", "base", "salt", "organic", "inorganic", "structure", "smiles", "chemical")
SCORE_PHYSICS = ("force", "velocity", "acceleration", "energy", "momentum", "wave", "field", "charge", "magnetic", "electric", "motion", "particle", "temperature", "pressure", "optics", "mechanics")
ARGMAX = {
    "Mathematics": ("differentiation", "integration", "derivative", "integral", "matrix", "calculus", "trigonometry", "polynomial", "equation", "algebra", "function", "limit", "series", "sum", "coefficient"),
    "Physics": ("force", "velocity", "acceleration", "energy", "momentum", "electricity", "magnetic", "optics", "wave", "thermodynamics", "mechanics", "motion", "speed", "power", "current"),
    "Chemistry": ("molecule", "atom", "compound", "reaction", "bond", "acid", "base", "organic", "inorganic", "redox", "electron", "valence", "isotope", "element", "oxidation"),
}


def by_priority(text: str | Column, rules: Iterable[tuple[str, Iterable[str]]] = (("Chemistry", PRIORITY_CHEMISTRY), ("Physics", PRIORITY_PHYSICS)), default: str = "Mathematics") -> Column:
    """The first rule with a keyword in the text."""
    col = as_column(text)
    return F.coalesce(*[F.when(col.rlike(any_of(words)), F.lit(label)) for label, words in rules], F.lit(default))


def by_score(text: str | Column, first: Iterable[str] = SCORE_CHEMISTRY, second: Iterable[str] = SCORE_PHYSICS, labels: tuple[str, str, str] = ("Chemistry", "Physics", "Mathematics")) -> Column:
    """More different keywords of the first table, else any of the second, else the default."""
    a, b = count_present(text, first), count_present(text, second)
    return F.when(a > b, labels[0]).when(b > 0, labels[1]).otherwise(labels[2])


def by_argmax(text: str | Column, tables: Mapping[str, Iterable[str]] = ARGMAX) -> Column:
    """Most different keywords; ties and zeros go to the earlier table."""
    scores = [count_present(text, words) for words in tables.values()]
    top = F.greatest(*scores)
    return F.coalesce(*[F.when(s == top, F.lit(label)) for label, s in zip(tables, scores, strict=True)])


def type_by_text(text: str | Column) -> Column:
    """C4."""
    low = F.lower(as_column(text))
    has = lambda w: F.contains(low, F.lit(w))
    return (
        F.when(has("column") & has("match"), "Match the Column")
        .when(has("assert") | has("reason"), "Assertion-Reason")
        .when(has("value") | has("find") | has("calculate"), "Numerical")
        .otherwise("MCQ")
    )


def type_by_options(text: str | Column, n_options: str | Column) -> Column:
    """C5."""
    low, n = F.lower(as_column(text)), as_column(n_options)
    return F.when(n == 4, "MCQ").when(n == 0, "Numerical").when(F.contains(low, F.lit("match")), "Match the Column").when(low.rlike("assertion|reason"), "Assertion-Reason").otherwise("MCQ")


def type_constant() -> Column:
    """C6."""
    return F.lit("MCQ")
