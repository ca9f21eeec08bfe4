"""Operator 12, document fingerprints by a threshold-scaled sketch.

A sketch keeps every shingle hash below a fixed fraction of the hash range,
however long the text.  So sketches of different texts keep the same hashes of
what the texts share: the sketch of a union is the union of the sketches, and
the share of a small document's hashes that a large one holds estimates
containment, which sketches of a fixed number of hashes cannot.

A text of which no hash is below the threshold keeps its smallest one, so that
every text with a word has a fingerprint.  Merging stays defined: unite, and
keep what is below the threshold, or the smallest if nothing is.

All of it is DataFrame functions.  The next document is found over keys alone;
texts are shuffled once, by their own key, and read from there for both joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rewrite import let
from .mixing import in_order
from .staging import Staged

GAP = r"[\x20\x09-\x0D]+"
SHINGLE = 5
#: One hash in so many is kept.
SCALE = 8
KEY = ["none", "id", "h"]


def limit(scale: int) -> int:
    """Hashes, as signed 64-bit values, below this are kept."""
    return -(1 << 63) + (1 << 64) // scale


def shingles(text: Column, size: int = SHINGLE) -> Column:
    """Hashes of all runs of ``size`` words, repeats included; of fewer words, the hash of them all."""
    words = F.filter(F.split(text, GAP), lambda w: w != "")
    runs = lambda h: F.transform(F.sequence(F.lit(0), F.greatest(F.size(h) - size, F.lit(0))), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(size)]))
    return let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: F.when(F.size(h) > 0, runs(h)).otherwise(F.array().cast("array<bigint>")))


def kept(hashes: Column, scale: int = SCALE) -> Column:
    """What a sketch keeps of some hashes: ascending, without repeats."""
    below = lambda s: F.array_sort(F.array_distinct(F.filter(s, lambda h: h < limit(scale))))
    return let(hashes, lambda s: let(below(s), lambda k: F.when((F.size(k) > 0) | (F.size(s) == 0), k).otherwise(F.array(F.array_min(s)))))


def sketch(text: Column, size: int = SHINGLE, scale: int = SCALE) -> Column:
    """The threshold-scaled sketch of a text (null: of the empty text)."""
    return kept(shingles(F.coalesce(text, F.lit("")), size), scale)


def merged(a: Column, b: Column, scale: int = SCALE) -> Column:
    """The sketch of all shingles of two sketched texts."""
    return kept(F.array_union(a, b), scale)


def containment(a: Column, b: Column) -> Column:
    """Share of the smaller sketch that the larger one holds; two empty ones are alike, one empty one is like no other."""
    least = F.least(F.size(a), F.size(b))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least).when(F.size(a) + F.size(b) == 0, F.lit(1.0)).otherwise(F.lit(0.0))


def digits(a: Column) -> Column:
    """A sketch as text: 16 hexadecimal digits for each hash."""
    return F.array_join(F.transform(a, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), "")


def followers(rows: DataFrame, staged: Staged) -> tuple[DataFrame, bool]:
    """(keys of a document, keys of the next one as next_*, quarter), and whether any key names several rows.

    Rows in ascending order of doc_id (null last), those that share one by
    their text's hash; rows alike in both have one place in the order.
    """
    keys = rows.groupBy(*KEY).agg(F.count("*").alias("n"), F.max(F.length("text")).alias("n_chars"))
    keys = in_order(keys, staged, *KEY)
    parts = keys.groupBy("part").agg(F.count("*").alias("c"))
    before = F.coalesce(F.sum("c").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("part", before.alias("before"))
    index = F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    placed = keys.join(F.broadcast(parts), "part").select(*KEY, "n", "n_chars", (F.col("before") + index).alias("nth"))  # as many parts as sorted ones
    total, repeats = keys.agg(F.count("*"), F.max("n")).first()
    ahead = placed.select(*[F.col(c).alias(f"next_{c}") for c in KEY], F.col("nth").alias("to"))
    links = placed.withColumn("to", (F.col("nth") + 1) % max(total, 1)).join(ahead, "to")
    return links.select(*KEY, *[f"next_{c}" for c in KEY], F.floor(F.col("n_chars") / 4).cast("int").alias("quarter")), (repeats or 0) > 1


def fingerprints(docs: DataFrame, size: int = SHINGLE, scale: int = SCALE) -> DataFrame:
    """Fingerprint of every whole text, and how like it is its edited text's and the next document's.

    The edited text has the last quarter of its code points replaced by the
    first as many (or all) of the next document, in ascending doc_id; after the
    last comes the first.  Returns doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited and near_next, both the ``containment`` of
    the smaller sketch in the larger.

    A null text is empty; an empty text, or one of white space, has the empty
    fingerprint, like only to its own kind.  Fewer than ``size`` words are one
    shingle; very long texts are hashed whole.  A null doc_id comes last.  Rows
    that share a doc_id follow each other by the hash of their text; those
    alike in text too have one place and equal results.  A table of one such
    place is its own next document.  An empty table gives an empty table;
    other columns are not read.
    """
    staged = Staged(docs.sparkSession, "sketch")
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.isnull("doc_id").alias("none"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"), F.xxhash64(text).alias("h"), text.alias("text"))
    links, repeats = followers(rows, staged)
    ahead = rows.select(*[F.col(c).alias(f"next_{c}") for c in KEY], F.col("text").alias("next_text"))  # the same exchange as below
    heads = ahead.join(links, [f"next_{c}" for c in KEY])
    heads = heads.select(*KEY, F.substr("next_text", F.lit(1), F.col("quarter")).alias("head"), sketch(F.col("next_text"), size, scale).alias("next_sk"))
    if repeats:
        heads = heads.dropDuplicates(KEY)
    n = F.length("text")
    both = rows.join(heads, KEY).withColumn("n", n).withColumn("edited", F.concat(F.substr("text", F.lit(1), F.col("n") - F.floor(F.col("n") / 4).cast("int")), "head"))
    both = both.withColumns({"sk": sketch(F.col("text"), size, scale), "edited_sk": sketch(F.col("edited"), size, scale)})
    return both.select(
        F.when(~F.col("none"), F.col("id")).alias("doc_id"),
        F.col("n").cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        digits(F.col("sk")).alias("fingerprint"),
        digits(F.col("edited_sk")).alias("edited_fingerprint"),
        containment(F.col("sk"), F.col("edited_sk")).alias("near_edited"),
        containment(F.col("sk"), F.col("next_sk")).alias("near_next"),
    )
