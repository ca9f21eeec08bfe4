"""Sinks (inventory S13-S19, S22)."""

from __future__ import annotations

import shutil
import subprocess
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def to_jsonl(items: DataFrame, path: str) -> None:
    """S13."""
    items.write.mode("overwrite").json(path)


def to_stats_json(stats: DataFrame, path: str) -> None:
    """Totals as one JSON object below ``totals``, a line for each paper below ``per_paper``."""
    numbers = [f.name for f in stats.schema.fields if f.dataType.typeName() in ("byte", "short", "integer", "long", "float", "double")]
    stats.agg(F.count("*").alias("rows"), *[F.sum(c).alias(c) for c in numbers]).coalesce(1).write.mode("overwrite").json(f"{path}/totals")
    stats.write.mode("overwrite").json(f"{path}/per_paper")


def to_paper_folders(items: DataFrame, path: str) -> None:
    """JSON below one folder a paper."""
    items.write.mode("overwrite").partitionBy("paper_id").json(path)


def to_consolidated_json(papers: DataFrame, path: str) -> None:
    """One JSON line a paper, in one file."""
    papers.coalesce(1).write.mode("overwrite").json(path)


def to_vector_store(rows: DataFrame, path: str) -> None:
    """Parquet (vec_id, embedding, meta)."""
    rows.write.mode("overwrite").parquet(path)


def to_parsed_json(items: DataFrame, path: str, method: str = "markdown") -> None:
    """A document a paper with its header and questions."""
    fields = [c for c in items.columns if c != "paper_id"]
    docs = items.groupBy("paper_id").agg(F.count("*").alias("total_questions"), F.array_sort(F.collect_list(F.struct("question_number", *[c for c in fields if c != "question_number"]))).alias("questions"))
    docs.withColumn("parsing_method", F.lit(method)).write.mode("overwrite").json(path)


def latex_installed() -> bool:
    """S22."""
    return shutil.which("pdflatex") is not None


def compile_latex(document: str, target: str, timeout: int = 120) -> bool:
    """Two runs of the compiler on the driver; true if a PDF came out."""
    if not latex_installed():
        return False
    with tempfile.TemporaryDirectory() as d:
        (Path(d) / "paper.tex").write_text(document, encoding="utf-8")
        for _ in range(2):
            subprocess.run(["pdflatex", "-interaction=nonstopmode", "paper.tex"], cwd=d, capture_output=True, timeout=timeout, check=False)
        made = Path(d) / "paper.pdf"
        if made.exists():
            shutil.copy(made, target)
        return made.exists()
