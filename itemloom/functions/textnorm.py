"""Normalising noisy scientific text (inventory N1-N12): Column in, Column out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rewrite import any_of, as_column, rewrite, strip

# Code points folded one to one, unit letters, functions, markers.
FOLD_FROM = "−𝑔𝑇𝑅𝜃𝜋𝐿𝑀𝑡"
FOLD_TO = "-gTRθπLMt"
FRACTION_UNITS = ("m", "R", "N", "J", "kg", "L", "C", "V", "A", "T", "H", "F")
POWER_UNITS = ("m", "s", "kg", "N", "J", "W", "Hz", "Pa", "C", "V", "F", "Ω", "ohm")
FUNCTIONS = ("sin", "cos", "tan", "cot", "sec", "cosec")
JUNK_MARKERS = ("JEE Main 2024", "JEE Main 2025", "MathonGo", "https://", "www.")
JUNK_MARKERS_SHORT = ("JEE Main 2024", "MathonGo", "https://")


def fold_unicode(c: str | Column) -> Column:
    """N1."""
    return F.translate(as_column(c), FOLD_FROM, FOLD_TO)


def close_decimals(c: str | Column, unicode: bool = True) -> Column:
    """One pass; a second never changes anything."""
    return rewrite(c, [(r"(\d)\s*\.\s*(\d)", "$1.$2")], unicode)


def close_percents(c: str | Column, unicode: bool = True) -> Column:
    """N3."""
    return rewrite(c, [(r"(\d(?:\.\d+)?)\s*%", "$1%")], unicode)


def space_units(c: str | Column, unicode: bool = True) -> Column:
    """N4."""
    return rewrite(c, [(r"(\d(?:\.\d+)?)\s*([A-Za-z](?:[A-Za-z])?)\b", "$1 $2")], unicode)


def simple_fractions(c: str | Column, unicode: bool = True) -> Column:
    """N5."""
    units = "|".join(FRACTION_UNITS)
    return rewrite(c, [(rf"\b([1-9])\s+([1-9])\s+({units})\b", "$1/$2 $3"), (r"\b([1-9]\d?)\s+([1-9]\d?)\b(?=\s*\n?\z|\s*[,;:)])", "$1/$2")], unicode)


def exponents(c: str | Column, unicode: bool = True) -> Column:
    """The order matters."""
    units = "|".join(POWER_UNITS)
    folded = F.translate(as_column(c), "−", "-")
    return rewrite(folded, [(r"(?i)(\d+(?:\.\d+)?)\s*[x×]\s*10\s*(?:\^\s*)?(\d+)", "$1 x 10^$2"), (r"10\s*[-−]\s*(\d+)", "10^-$1"), (rf"({units})\s+[-−]\s*(\d+)", "$1^-$2")], unicode)


def function_arguments(c: str | Column, unicode: bool = True) -> Column:
    """N7."""
    return rewrite(c, [(rf"\b({'|'.join(FUNCTIONS)})\s+([-−]?\d+(?:\.\d+)?)", "$1($2)")], unicode)


def dimensional_formulas(c: str | Column, unicode: bool = True) -> Column:
    """Rewrites inside brackets only; EN DASH counts as a minus (decision B17)."""
    col, bracket = as_column(c), r"\[.*?\]"
    outside = F.split(col, bracket, -1)
    inside = F.transform(F.regexp_extract_all(col, F.lit(bracket), F.lit(0)), lambda x: rewrite(x, [(r"\s+[−–-]\s+(\d+)", "^-$1")], unicode))
    inside = F.concat(inside, F.array(F.lit("")))
    return F.array_join(F.flatten(F.zip_with(outside, inside, lambda a, b: F.array(a, b))), "")


def collapse_spaces(c: str | Column, unicode: bool = True) -> Column:
    """N9."""
    return strip(rewrite(c, [(r"\s{2,}", " ")], unicode), unicode)


def normalise(c: str | Column, unicode: bool = True) -> Column:
    """All of the above in their fixed order; null and empty pass through."""
    out = fold_unicode(c)
    for step in (close_decimals, space_units, simple_fractions, exponents, dimensional_formulas, function_arguments, close_percents, collapse_spaces):
        out = step(out, unicode)
    return out


def normalise_all(options: str | Column, unicode: bool = True) -> Column:
    return F.transform(as_column(options), lambda x: normalise(x, unicode))


def strip_junk(c: str | Column, markers: tuple[str, ...] = JUNK_MARKERS, ignore_case: bool = True) -> Column:
    """N11 (and N12 with the short list, case-sensitive): cut at the earliest marker, trimmed at the right."""
    flags = "(?isU)" if ignore_case else "(?sU)"
    return F.regexp_replace(as_column(c), flags + r"\s*(?:" + any_of(markers, False) + ").*", "")
