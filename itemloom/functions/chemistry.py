"""Line notation of molecules (inventory N33-N35, V4, U5)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rewrite import as_column

# Atom weights, allowed marks, diagram kinds in order.
WEIGHTS = {"H": 1.008, "C": 12.011, "N": 14.007, "O": 15.999, "S": 32.06, "P": 30.974, "F": 18.998, "Cl": 35.45, "Br": 79.904, "I": 126.90, "B": 10.811, "Si": 28.086}
MARKS = "()[]=#\\/@-+%"
DIAGRAMS = (("structure", "structure|compound|molecule|organic"), ("reaction", "reaction|mechanism|pathway"), ("orbital", "orbital"), ("graph", "graph|chart|plot"), ("apparatus", "apparatus|setup|equipment"))


def diagram_kind(filename: str | Column) -> Column:
    """The first matching kind, else 'general'."""
    low = F.lower(as_column(filename))
    return F.coalesce(*[F.when(low.rlike(p), F.lit(k)) for k, p in DIAGRAMS], F.lit("general"))


def weight_estimate(smiles: str | Column) -> Column:
    """Symbol counts times weights (Cl also counts as C); null where nothing counts."""
    col = as_column(smiles)
    total = reduce(lambda a, b: a + b, [F.regexp_count(col, F.lit(s)) * F.lit(w) for s, w in WEIGHTS.items()])
    return F.when(total > 0, F.round(total, 2))


def elements(smiles_list: str | Column) -> Column:
    """Different element symbols over all strings, sorted."""
    found = F.flatten(F.transform(as_column(smiles_list), lambda s: F.regexp_extract_all(s, F.lit("([A-Z][a-z]?)"), F.lit(1))))
    return F.array_sort(F.array_distinct(found))


def odd_characters(smiles: str | Column) -> Column:
    """Characters that are neither letters, digits nor allowed marks."""
    chars = F.array_except(F.split(as_column(smiles), ""), F.lit(list(MARKS)))
    return F.filter(chars, lambda x: ~x.rlike(r"^[\p{L}\p{N}]?$"))


def smiles_error(smiles: str | Column) -> Column:
    """V4: the first error, null if valid."""
    col = as_column(smiles)
    n = lambda p: F.regexp_count(col, F.lit(p))
    return (
        F.when(F.coalesce(col, F.lit("")) == "", "SMILES must be a non-empty string")
        .when(n(r"\[") != n(r"\]"), "Unbalanced square brackets")
        .when(n(r"\(") != n(r"\)"), "Unbalanced parentheses")
        .when(F.size(odd_characters(col)) > 0, "Invalid characters in SMILES")
    )


def recogniser_lines(output: str | Column) -> Column:
    """S20's text side: lines 'SMILES confidence' as structs, confidence 0.5 by default, invalid ones dropped."""
    lines = F.filter(F.transform(F.split(as_column(output), "\n"), lambda x: F.trim(x)), lambda x: x != "")
    parsed = F.transform(lines, lambda x: F.struct(F.split(x, r"\s+")[0].alias("smiles"), F.coalesce(F.get(F.split(x, r"\s+"), F.lit(1)).try_cast("double"), F.lit(0.5)).alias("confidence")))
    return F.filter(parsed, lambda p: smiles_error(p.smiles).isNull())
