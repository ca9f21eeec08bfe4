"""Scans (inventory S1-S12, S20, S21, S23, S24, P19).

External converters (PDF, image recognisers, markdown models) are plug-ins of
``converted``; everything after the span table is columns.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..shared import Store


def documents_json(spark: SparkSession, path: str, schema: str, glob: str = "*.json") -> DataFrame:
    """Nested JSON documents below a folder, one row a file; what can't be parsed is in ``_corrupt_record``."""
    reader = spark.read.schema(schema + ", _corrupt_record string").option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record")
    rows = reader.option("recursiveFileLookup", True).option("pathGlobFilter", glob).json(path)
    return rows.withColumn("source_path", F.col("_metadata.file_path"))


def jsonl(spark: SparkSession, path: str, schema: str = schemas.TAGGED, defaults: dict | None = None) -> DataFrame:
    """One object a line; blank lines are skipped, missing values filled."""
    rows = spark.read.schema(schema).json(path)
    known = {k: v for k, v in (schemas.DEFAULTS if defaults is None else defaults).items() if k in rows.columns}
    rows = rows.na.fill(known)
    return rows.withColumn("options", F.coalesce("options", F.array().cast("array<string>"))) if "options" in rows.columns else rows


def jsonl_with_ordinal(spark: SparkSession, path: str, schema: str = schemas.TAGGED) -> DataFrame:
    """Adds ``_idx``, the physical line in its file (from 0, blank lines count), and ``_path``; large files are read by many tasks."""
    from ..operators.ordinal import numbered_lines

    lines = numbered_lines(spark, path).where("trim(value) <> ''")
    return lines.select("path", "line", F.from_json("value", schema).alias("r")).select(F.col("line").alias("_idx"), F.col("path").alias("_path"), "r.*")


def whole_texts(spark: SparkSession, path: str, glob: str = "*.mmd") -> DataFrame:
    """(paper_id, content), the id being the file's stem."""
    rows = spark.read.option("pathGlobFilter", glob).text(path, wholetext=True)
    return rows.select(F.regexp_replace("_metadata.file_name", r"\.[^.]*$", "").alias("paper_id"), F.col("value").alias("content"))


def spans(extractions: DataFrame) -> DataFrame:
    """S1's output side: one row a text span, in reading order."""
    rows = extractions.select("paper_id", F.posexplode("text_blocks").alias("pos", "b"))
    return rows.select("paper_id", "pos", F.col("b.page").alias("page"), F.trim("b.text.text").alias("text"), F.col("b.text.coordinates").alias("box")).where("text <> ''")


def span(text: str, box: tuple[str, str, str, str]):
    """A span's struct, coordinates to two digits."""
    x0, y0, x1, y1 = [F.col(c) for c in box]
    two = lambda c, n: F.round(c, 2).alias(n)
    return F.struct(F.col(text).alias("text"), F.struct(two(x0, "x0"), two(y0, "y0"), two(x1, "x1"), two(y1, "y1"), two(x1 - x0, "width"), two(y1 - y0, "height")).alias("coordinates"), F.lit("text").alias("block_type"))


def images(extractions: DataFrame) -> DataFrame:
    """S3's output side: one row an image."""
    return extractions.select("paper_id", F.explode("images").alias("i")).select("paper_id", "i.*")


def page_sizes(pages: DataFrame) -> DataFrame:
    """Pages (paper_id, page, width, height) to one row a paper."""
    return pages.groupBy("paper_id").agg(F.max("page").alias("total_pages"), F.array_sort(F.collect_list(F.struct("page", "width", "height"))).alias("page_dimensions"))


def extraction(span_rows: DataFrame, image_rows: DataFrame, size_rows: DataFrame) -> DataFrame:
    """The composite document row."""
    s = span_rows.groupBy("paper_id").agg(F.array_sort(F.collect_list(F.struct("pos", "page", "text"))).alias("text_blocks"))
    i = image_rows.groupBy("paper_id").agg(F.array_sort(F.collect_list(F.struct("page", "filename", "width", "height"))).alias("images"))
    return size_rows.join(s, "paper_id", "left").join(i, "paper_id", "left").withColumn("timestamp", F.current_timestamp().cast("string"))


def discovered(spark: SparkSession, path: str, glob: str, limit: int | None = None) -> DataFrame:
    """Files by name pattern, sorted; contents are not read."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path).select("path", "length", "modificationTime").orderBy("path")
    return rows.limit(limit) if limit is not None else rows


def paper_folders(spark: SparkSession, path: str, prefix: str, holds: str) -> DataFrame:
    """(folder, path) of the folders directly in ``path`` whose name begins with ``prefix`` and that hold a file named by the pattern ``holds`` themselves, sorted."""
    below = F.split(F.substr("path", F.lit(len(Store(spark).qualified(path)) + 2)), "/")
    files = discovered(spark, path, holds).where(F.size(below) == 2).select(below[0].alias("folder"), F.regexp_replace("path", "/[^/]*$", "").alias("path"))
    return files.where(F.startswith("folder", F.lit(prefix))).distinct().orderBy("folder")


def answer_key_file(spark: SparkSession, path: str, glob: str = "*.json") -> DataFrame:
    """P20: (paper_id, question_number, answer) from extraction files with text_blocks; a file that can't be read gives no row."""
    from ..operators.answers import answer_key, combined_text

    # blocks stay text, since a block's own text may be an object or a string
    rows = documents_json(spark, path, "paper_id string, text_blocks array<string>", glob).where("_corrupt_record is null")
    return answer_key(rows.select("paper_id", combined_text(F.to_json("text_blocks")).alias("text")))


def converted(spark: SparkSession, path: str, glob: str, convert: Callable[[str, bytes], list[tuple[int, int, str]]]) -> DataFrame:
    """Files through an external converter that gives (pos, page, text) spans; a file that fails has an error row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for name, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    rows += [(name, pos, page, text, None) for pos, page, text in convert(name, content)]
                except Exception as e:  # noqa: BLE001  one bad file must not end the scan
                    rows.append((name, None, None, None, str(e)))
            yield pd.DataFrame(rows, columns=["path", "pos", "page", "text", "error"])

    from ..shipping import ship

    ship(spark)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path).select("path", "content")
    return files.mapInPandas(run, "path string, pos int, page int, text string, error string")


@dataclass
class Config:
    """Settings from the environment, overlaid by a JSON file; a bad or missing file changes nothing."""

    input_dir: str = field(default_factory=lambda: os.environ.get("ITEMLOOM_INPUT", "data"))
    output_dir: str = field(default_factory=lambda: os.environ.get("ITEMLOOM_OUTPUT", "out"))
    workers: int = field(default_factory=lambda: int(os.environ.get("ITEMLOOM_WORKERS", "2")))
    markdown: bool = field(default_factory=lambda: os.environ.get("ITEMLOOM_MARKDOWN", "false").lower() == "true")

    @classmethod
    def load(cls, path: str | None = None) -> Config:
        out = cls()
        try:
            for k, v in json.loads(Path(path).read_text()).items() if path else ():
                if hasattr(out, k):
                    setattr(out, k, v)
        except (OSError, ValueError):
            pass
        return out


def cached(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """A staged table, made where there is no whole one (``store``)."""
    from .store import kept

    return kept(spark, path, make)[0]
