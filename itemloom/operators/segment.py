"""From reading-order spans and whole texts to items (inventory P1-P13, S6, S7)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.prompts import digit_answer, finish_stem, letter_answer
from ..functions.rewrite import as_column, first_group, let, rewrite, strip
from ..functions.textnorm import collapse_spaces
from .classify import by_priority, by_score, type_by_text

START = r"(?U)^Q\s*\.?\s*(\d+)\s*[).:-]?$"
MARKER = r"^\(([1-4])\)$"
TASKS = 200


def joined(entry: Column, when: Column, sep: str) -> Column:
    """Texts of the rows for which ``when`` holds, in reading order."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.when(when, entry))), lambda x: x.text), sep)


def texts(entries: Column) -> Column:
    """Texts of entries that are in order, as one."""
    return F.array_join(F.transform(entries, lambda x: x.text), " ")


def tasks(spark: SparkSession) -> int:
    """Parts that papers are dealt to: ``TASKS``, or more where the session has more.

    A number of its own, since spans are short and pack so well that Spark
    would put millions of them into one task by their size on the wire.
    """
    return max(TASKS, int(spark.conf.get("spark.sql.shuffle.partitions")))


def marker_items(spans: DataFrame) -> DataFrame:
    """Spans (paper_id, pos, page, text) to items (paper_id, question_number, question_text, options, page_start, page_end).

    A running sum of start spans numbers the segments of a paper; each segment
    is then one list of its spans, which everything else is read off, so there
    is no join and spans are sorted and gathered once.  Of a marker that repeats
    the last occurrence counts; options come out in reading order; without all
    four markers the text is tried for inline options (P2).
    """
    paper = Window.partitionBy("paper_id").orderBy("pos")
    rows = spans.select("paper_id", "pos", "page", strip(F.coalesce("text", F.lit(""))).alias("text"))
    rows = rows.withColumn("starts", first_group("text", START).try_cast("int"))
    rows = rows.withColumn("marker", F.when(F.col("starts").isNull(), first_group("text", MARKER).try_cast("int")))
    rows = rows.repartition(tasks(spans.sparkSession), "paper_id")
    rows = rows.withColumn("seg", F.count("starts").over(paper)).where("seg > 0")
    body = F.col("starts").isNull()
    out = rows.groupBy("paper_id", "seg").agg(
        F.max("starts").alias("question_number"),
        F.collect_list(F.when(body & ((F.col("text") != "") | F.col("marker").isNotNull()), F.struct("pos", "text", "marker"))).alias("spans"),
        *[F.max(F.when(F.col("marker") == i, F.col("pos"))).alias(f"last{i}") for i in range(1, 5)],
        F.min(F.when(F.col("marker").isNotNull(), F.col("pos"))).alias("first_marker"),
        F.coalesce(F.min(F.when(body, F.col("page"))), F.lit(-1)).alias("page_start"),
        F.coalesce(F.max(F.when(body, F.col("page"))), F.lit(-1)).alias("page_end"),
    )
    marked = F.col("last1").isNotNull() & F.col("last2").isNotNull() & F.col("last3").isNotNull() & F.col("last4").isNotNull()
    out = out.withColumns({"spans": F.array_sort("spans"), "marked": marked})
    last = F.array("last1", "last2", "last3", "last4")
    opens = F.filter("spans", lambda x: x.marker.isNotNull() & (x.pos == F.get(last, x.marker - 1)))
    out = out.withColumns({
        "plain": F.filter("spans", lambda x: x.marker.isNull()),
        "opens": F.when(F.col("marked"), F.transform(opens, lambda x: x.pos)),
    })
    before = lambda x: F.col("first_marker").isNull() | (x.pos < F.col("first_marker"))
    slot = lambda x: F.size(F.filter("opens", lambda o: o <= x.pos))
    out = out.withColumns({
        "stem": texts(F.filter("plain", before)),
        "whole": F.when(~F.col("marked"), texts(F.filter("spans", lambda x: x.text != ""))),
        "slots": F.when(F.col("marked"), F.transform(F.filter("plain", lambda x: ~before(x)), lambda x: F.struct(slot(x).alias("slot"), x.text.alias("text")))),
    }).drop("spans", "plain", "opens")
    slots = F.transform(F.sequence(F.lit(1), F.lit(4)), lambda i: texts(F.filter("slots", lambda x: x.slot == i)))
    inline = inline_options("whole")
    none = F.array().cast("array<string>")
    return out.select(
        "paper_id", "seg", "question_number",
        F.when(F.col("marked"), F.col("stem")).otherwise(F.coalesce(inline.stem, F.col("stem"))).alias("question_text"),
        F.when(F.col("marked"), F.filter(slots, lambda x: x != "")).otherwise(F.coalesce(inline.options, none)).alias("options"),
        "page_start", "page_end",
    ).where("question_text <> ''")


def inline_options(text: str | Column) -> Column:
    """struct(stem, options by number) if exactly the markers (1)-(4) occur, each one's first place; else null."""
    col = as_column(text)
    found = F.array_sort(F.array_distinct(F.regexp_extract_all(col, F.lit(r"\((\d+)\)"), F.lit(1))))
    at = F.array_sort(F.array(*[F.struct(F.locate(f"({n})", col).alias("at"), F.lit(n).alias("n")) for n in range(1, 5)]))
    ends = F.transform(at, lambda m, i: F.struct(m.n.alias("n"), strip(F.substring(col, m.at + 3, F.coalesce(F.get(at, i + 1).at, F.length(col) + 1) - m.at - 3)).alias("text")))
    options = F.transform(F.array_sort(ends), lambda x: x.text)
    stem = strip(F.substring(col, F.lit(1), F.get(at, F.lit(0)).at - 1))
    return F.when(found == F.lit(["1", "2", "3", "4"]), F.struct(stem.alias("stem"), options.alias("options")))


def four_chunks(text: str | Column) -> Column:
    """Cut after the last ':' or '?', the tail's words in four near-equal parts."""
    col = as_column(text)
    words = F.filter(F.split(strip(F.regexp_replace(col, r"(?s)^.*[:?]", "")), r"\s+"), lambda x: x != "")

    def cut(tail: Column) -> Column:
        n = F.size(tail)
        size = F.floor(n / 4).cast("int")
        parts = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.array_join(F.slice(tail, (i * size + F.least(i, n % 4) + 1).cast("int"), (size + F.when(i < n % 4, 1).otherwise(0)).cast("int")), " "))
        usable = col.rlike("[:?]") & (n >= 4)
        return F.struct(F.when(usable, first_group(col, r"(?s)^(.*[:?])")).otherwise(col).alias("stem"), F.when(usable, parts).otherwise(F.array().cast("array<string>")).alias("options"))

    return let(words, cut)


def prefix_items(spans: DataFrame) -> DataFrame:
    """Items opened by a 'Qn' prefix; '(n) text' spans are options, the last of a number counts."""
    paper = Window.partitionBy("paper_id").orderBy("pos")
    rows = spans.select("paper_id", "pos", strip(F.coalesce("text", F.lit(""))).alias("text")).where("text <> ''")
    rows = rows.withColumn("number", first_group("text", r"(?i)^Q\s*\.?\s*(\d+)").try_cast("int"))
    rows = rows.withColumn("seg", F.count("number").over(paper)).where("seg > 0")
    rows = rows.withColumn("option", F.when(F.col("number").isNull(), first_group("text", r"^\(?([1-4])\)")))
    says = F.col("text").rlike(r"(?i)^(?:correct\s+)?answer")
    entry = F.struct("pos", "text")
    plain = F.col("option").isNull() & ~says
    body = F.when(F.col("number").isNotNull(), rewrite("text", [(r"(?i)^Q\s*\.?\s*\d+\s*[).:-]?\s*", "")])).otherwise(F.col("text"))
    rows = rows.withColumn("text", body)
    options = [F.max_by(F.when(F.col("option") == str(n), F.col("text")), F.when(F.col("option") == str(n), F.col("pos"))) for n in range(1, 5)]
    listed = F.filter(F.array(*[F.struct(F.lit(str(n)).alias("id"), o.alias("text")) for n, o in zip(range(1, 5), options, strict=True)]), lambda o: o.text.isNotNull())
    out = rows.groupBy("paper_id", "seg").agg(
        F.max("number").alias("question_number"), joined(entry, plain & (F.col("text") != ""), " ").alias("question_text"),
        listed.alias("options"), F.max_by(F.when(says, letter_answer("text")), F.when(says, F.col("pos"))).alias("answer"),
    ).where("question_text <> '' and size(options) > 0")
    return out.withColumns({"correct_answer": F.coalesce("answer", F.lit("1")), "subject": by_priority("question_text"), "question_type": type_by_text("question_text")}).drop("answer")


def markdown_sections(pages: DataFrame, content: str = "content") -> DataFrame:
    """One row for each 'Qn' section of a whole file."""
    parts = F.split(F.col(content), r"(?mi)(?=^Q\d+)")
    rows = pages.select("*", F.posexplode(parts).alias("pos", "section"))
    return rows.withColumn("question_number", first_group("section", r"(?i)^Q(\d+)").try_cast("int")).where("question_number is not null").withColumn("section", F.regexp_replace("section", r"(?i)^Q\d+\s*[.)\-:]?\s*", ""))


OPTION = r"(?s)\(([1-4])\)\s*(.+?)(?=\n\s*\([1-4]\)|\n\s*(?:Answer|Correct)|\z)"


def section_options(section: str | Column) -> Column:
    """struct(options with id, latex and text; rest, the text before the first)."""
    col = as_column(section)
    raw = F.zip_with(F.regexp_extract_all(col, F.lit(OPTION), F.lit(1)), F.regexp_extract_all(col, F.lit(OPTION), F.lit(2)), lambda i, t: F.struct(i.alias("id"), rewrite(collapse_spaces(rewrite(t, [(r"\s+", " ")], True)), [(r"^[.,;\n]+|[.,;\n]+$", "")]).alias("t")))
    kept = F.filter(raw, lambda o: o.t != "")
    at = F.regexp_instr(col, F.lit(OPTION))
    return F.struct(F.transform(kept, lambda o: F.struct(o.id.alias("id"), o.t.alias("latex"), o.t.alias("text"))).alias("options"), F.when(at > 0, F.substring(col, F.lit(1), at - 1)).otherwise(col).alias("rest"))


def markdown_items(pages: DataFrame) -> DataFrame:
    """Whole files (paper_id, content) to items; fewer than four options or no text drops a section."""
    from ..functions.names import question_id

    rows = markdown_sections(pages).withColumn("parsed", section_options("section"))
    rows = rows.where(F.size("parsed.options") >= 4).withColumn("question_latex", finish_stem("parsed.rest")).where("question_latex <> ''")
    return rows.select(
        "paper_id", question_id("paper_id", "question_number").alias("question_id"), "question_number", "question_latex",
        F.col("parsed.options").alias("options"), digit_answer("section").alias("correct_answer"),
        by_score("question_latex").alias("subject"), F.lit("MCQ").alias("question_type"),
    )


def split_by_number(text: str | Column) -> Column:
    """P10: sections cut at 'Qn.' or a line's 'n.', numbered by their order."""
    parts = F.filter(F.transform(F.split(as_column(text), r"Q\d+\.|\n\d+\."), lambda x: strip(x)), lambda x: x != "")
    return F.transform(parts, lambda x, i: F.struct((i + 1).alias("question_number"), x.alias("text")))


def lettered_options(text: str | Column) -> Column:
    """P11: 'A) text' options up to the next A-D letter or the line's end; empty ones dropped."""
    col, p = as_column(text), r"(?ms)\(?([A-D])\)\.?\s*([^A-D]*?)(?=\(?[A-D]\)?|$)"
    both = F.zip_with(F.regexp_extract_all(col, F.lit(p), F.lit(1)), F.regexp_extract_all(col, F.lit(p), F.lit(2)), lambda i, t: F.struct(i.alias("id"), strip(t).alias("text")))
    return F.filter(both, lambda o: o.text != "")


def question_blocks(texts: DataFrame, content: str = "content") -> DataFrame:
    """(paper_id, question_number, block); of a number that repeats the last block counts."""
    rows = texts.select("paper_id", F.posexplode(F.split(F.col(content), r"(?=Q\d+\.)")).alias("pos", "part"))
    rows = rows.withColumn("question_number", first_group("part", r"^Q(\d+)\.").try_cast("int")).where("question_number is not null")
    return rows.groupBy("paper_id", "question_number").agg(F.max_by(strip(F.regexp_replace("part", r"^Q\d+\.", "")), "pos").alias("block"))


def prompt_and_options(block: str | Column) -> Column:
    """struct(prompt, options or null) of newline-led '(n)' or '(A)' options."""
    col, p = as_column(block), r"(?s)\n\s*\(([1-4A-D])\)\s*(.*?)(?=\n\s*\([1-4A-D]\)|\z)"
    options = F.zip_with(F.regexp_extract_all(col, F.lit(p), F.lit(1)), F.regexp_extract_all(col, F.lit(p), F.lit(2)), lambda i, t: F.struct(i.alias("id"), strip(t).alias("text")))
    at = F.regexp_instr(col, F.lit(p))
    return F.struct(strip(F.when(at > 0, F.substring(col, F.lit(1), at - 1)).otherwise(col)).alias("prompt"), F.when(F.size(options) > 0, options).alias("options"))


def reading_order(elements: DataFrame) -> DataFrame:
    """Words and images of a page as one list in order of (top, x0)."""
    order = Window.partitionBy("source_file", "page_number").orderBy("top", "x0", "text", "path")
    return elements.withColumn("pos", F.row_number().over(order))


def split_last_page(spans: DataFrame) -> DataFrame:
    """Per paper the text of all pages but the last, and the last page as the key."""
    last = F.max("page").over(Window.partitionBy("paper_id"))
    rows = spans.withColumn("is_key", F.col("page") == last)
    entry = F.struct("pos", "text")
    return rows.groupBy("paper_id").agg(joined(entry, ~F.col("is_key"), "\n").alias("body"), joined(entry, F.col("is_key"), "\n").alias("key"))
