"""Answer keys and their joins (inventory P14-P20, S12, J1-J6, J9, J15)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.prompts import option_digit
from ..functions.rewrite import as_column, let, strip
from .ordinal import written
from .ranges import points_in_ranges

# Key formats in order of trust.
Q_PATTERN = r"(?mi)Q\s*\.?\s*(\d+)\s*[.)\-:]*\s*\((\d+)\)"
NUMBER_PATTERN = r"(?m)(?:^|\n)\s*(\d+)\s*[.)\-:]*\s*\((\d+)\)"
SEQUENCE_PATTERN = r"\((\d+)\)"
DOTTED_PATTERN = r"(\d+)\.\s*\(([^\)]+)\)"
SEQUENCE_LEAST = 10
ENTRY = "array<struct<pos:int,question_number:int,answer:string>>"
#: Texts of any length; without it a text of over 20 million characters makes its JSON null.
WHOLE = {"maxStringLen": str(2**31 - 1)}


def pairs(text: Column, pattern: str) -> Column:
    """(position, number, answer) of all matches."""
    numbers, answers = F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), F.regexp_extract_all(text, F.lit(pattern), F.lit(2))
    both = F.zip_with(numbers, answers, lambda n, a: F.struct(n.alias("n"), a.alias("a")))
    return F.transform(both, lambda x, i: F.struct(i.alias("pos"), x.n.try_cast("int").alias("question_number"), strip(x.a).alias("answer")))


def sequence_pairs(text: Column) -> Column:
    """Ten answers in a row or more are numbered from 1."""
    found = F.regexp_extract_all(text, F.lit(SEQUENCE_PATTERN), F.lit(1))
    numbered = F.transform(found, lambda a, i: F.struct(i.alias("pos"), (i + 1).alias("question_number"), a.alias("answer")))
    return F.when(F.size(found) >= SEQUENCE_LEAST, numbered).otherwise(F.array().cast(ENTRY))


def prioritised(text: str | Column) -> Column:
    """Entries of the first format that gives any."""
    col = as_column(text)
    some = lambda x: F.when(F.size(x) > 0, x)
    plain = F.filter(pairs(col, NUMBER_PATTERN), lambda x: x.question_number != 0)
    return F.coalesce(some(pairs(col, Q_PATTERN)), some(plain), some(sequence_pairs(col)), F.array().cast(ENTRY))


def last_wins(keys: DataFrame, entries: str = "entries", by: str = "paper_id") -> DataFrame:
    """One answer for each number; of repeats the last in reading order."""
    rows = keys.select(by, F.explode(entries).alias("e")).select(by, "e.*").where("question_number is not null")
    return rows.groupBy(by, "question_number").agg(F.max_by("answer", "pos").alias("answer"))


def answer_key(texts: DataFrame, text: str = "text") -> DataFrame:
    """(paper_id, question_number, answer) from whole key texts."""
    return last_wins(texts.select("paper_id", prioritised(text).alias("entries")))


def dotted_key(texts: DataFrame, text: str = "text") -> DataFrame:
    """P14: 'n. (answer)' with any text in the brackets."""
    return last_wins(texts.select("paper_id", pairs(F.col(text), DOTTED_PATTERN).alias("entries")))


def combined_text(blocks: str | Column, keep_empty: bool = False) -> Column:
    """JSON blocks whose text is a struct or a string, joined by newlines; others are skipped, and empty texts unless ``keep_empty``."""
    inner = lambda b: F.from_json(b, "text struct<text string>", WHOLE).text.text
    text = lambda b: let(F.from_json(b, "text string", WHOLE).text, lambda t: F.when(F.startswith(t, F.lit("{")), F.coalesce(inner(b), t)).otherwise(t))
    texts = F.transform(F.from_json(as_column(blocks), "array<string>", WHOLE), text)
    return F.array_join(F.filter(texts, lambda t: t.isNotNull() if keep_empty else t.isNotNull() & (t != "")), "\n")


def raw_answers(papers: DataFrame) -> DataFrame:
    """Papers (source_file, questions[question_number, correct_answer]) to one row a question, the last one counting."""
    rows = papers.select("source_file", F.posexplode("questions").alias("pos", "q"))
    rows = rows.select("source_file", "pos", F.col("q.question_number").try_cast("int").alias("question_number"), F.col("q.correct_answer").alias("raw_answer")).where("question_number is not null")
    return rows.groupBy("source_file", "question_number").agg(F.max_by("raw_answer", "pos").alias("raw_answer"))


def attach_key(items: DataFrame, key: DataFrame) -> DataFrame:
    """Left join of the paper's key (Spark broadcasts it where it is small)."""
    return items.join(key.withColumnRenamed("answer", "answer_raw"), ["paper_id", "question_number"], "left")


def verified(items: DataFrame, raw: DataFrame) -> DataFrame:
    """Items (source_file, question_number, correct_answer) against raw answers.

    Adds final_answer, status (verified, mismatch, extracted_only), confidence
    and notes; a missing or empty raw answer keeps the extracted one.
    """
    out = items.join(raw, ["source_file", "question_number"], "left").withColumn("raw_answer", F.nullif("raw_answer", F.lit("")))
    mapped = option_digit("raw_answer")
    same = F.lower(strip("correct_answer")) == F.lower(strip(mapped))
    return out.withColumns({
        "final_answer": F.coalesce(mapped, F.col("correct_answer")),
        "status": F.when(F.col("raw_answer").isNull(), "extracted_only").when(F.coalesce(same, F.lit(False)), "verified").otherwise("mismatch"),
        "confidence": F.when(F.col("raw_answer").isNull(), 0.7).when(F.coalesce(same, F.lit(False)), 0.95).otherwise(0.5),
        "notes": F.when(F.col("raw_answer").isNotNull() & ~F.coalesce(same, F.lit(False)), F.format_string("extracted %s, key %s", F.coalesce("correct_answer", F.lit("")), "raw_answer")),
    })


def overridden(items: DataFrame, extracted: DataFrame) -> DataFrame:
    """A key's answer takes the place of the item's; ``mapped`` says where."""
    key = extracted.withColumnRenamed("answer", "new_answer")
    out = items.join(key, ["paper_id", "question_number"], "left")
    return out.withColumns({"mapped": F.col("new_answer").isNotNull(), "correct_answer": F.coalesce("new_answer", "correct_answer")}).drop("new_answer")


def with_page_lists(items: DataFrame, lists: list[tuple[DataFrame, str, str]]) -> DataFrame:
    """J5, J6 as intended (decision B3): for each (per_page, value, name) the values of pages between page_start and page_end, pages from 1.

    Items are made once and written, since their ranges and their other columns
    are read apart; ranges are joined on blocks of pages, however long they are.
    """
    items = written(items, "items")
    spans, out = items.select("paper_id", "seg", "page_start", "page_end"), items
    for per_page, value, name in lists:
        found = points_in_ranges(per_page.where("page > 0").select("paper_id", "page", value), spans, "page", "page_start", "page_end", ["paper_id"])
        listed = found.groupBy("paper_id", "seg").agg(F.array_sort(F.collect_list(F.struct("page", value))).alias("v"))
        listed = listed.select("paper_id", "seg", F.transform("v", lambda x: x[value]).alias(name))  # noqa: B023  used at once
        out = out.join(listed, ["paper_id", "seg"], "left").withColumn(name, F.coalesce(name, F.array().cast("array<string>")))
    return out


def with_page_values(items: DataFrame, per_page: DataFrame, value: str, out: str) -> DataFrame:
    """One value of the pages that an item covers."""
    return with_page_lists(items, [(per_page, value, out)])


def with_tags(items: DataFrame, tags: DataFrame, keys: list[str]) -> DataFrame:
    """Tags with their defaults."""
    defaults = {"subject": "Unknown", "topic": "Unknown", "difficulty": "medium"}
    return items.join(tags, keys, "left").withColumns({c: F.coalesce(c, F.lit(d)) for c, d in defaults.items()})


def combined(items: DataFrame, images: DataFrame, molecules: DataFrame, confidence: float = 0.85) -> DataFrame:
    """Items with images and successful molecules of their pages."""
    good = molecules.where("status = 'success'").select("paper_id", "page", F.explode("smiles").alias("smiles"))
    out = with_page_lists(items, [(images, "filename", "question_images"), (good, "smiles", "chemical_smiles")])
    return out.withColumn("extraction_confidence", F.lit(confidence))
