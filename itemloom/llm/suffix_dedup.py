"""Operator 9, suffix-array dedup by sparse suffix arrays."""

from __future__ import annotations

from pyspark.sql import DataFrame

from . import sparse_suffix
from .substring_dedup import remove_repeats


def suffix_dedup(docs: DataFrame, length: int = 50, k: int = 8, with_text: bool = False) -> DataFrame:
    """Report and remove every passage of ``length`` words or more that stands at two places.

    Only suffixes at content-selected minimiser positions are kept, sorted and
    compared with their neighbours; matches are then extended to the left and
    right of the minimiser.  The union of all windows of ``length`` words that
    repeat is the union of all maximal repeats at least that long.

    Returns one row per document: doc_id, n_words, n_removed, kept_sha256,
    spans (repeated word intervals) and, if asked, kept_text.

    Nulls, empty texts, short texts, repeated rows, empty tables and further
    columns are handled as in ``substring_dedup``.
    """
    return remove_repeats(docs, length, k, sparse_suffix.repeated_windows, True, with_text)
