"""Running jobs: stages with stored results, batches with isolated errors (inventory O1-O3, O6)."""

from __future__ import annotations

import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession

from .operators.stats import batch_summary
from .sources.files import paper_folders
from .sources.store import kept

Stage = tuple[str, Callable[[DataFrame], DataFrame]]
RESULT = "name string, status string, duration double, error string"


def run_stages(source: DataFrame, stages: list[Stage], root: str) -> tuple[DataFrame, list[dict]]:
    """O1: each stage's rows are a committed table below ``root`` and the next one's input.

    Stages that are there whole are not run again; one that was cut off is.
    """
    now, report = source, []
    for i, (name, stage) in enumerate(stages):
        began = time.monotonic()
        now, there = kept(source.sparkSession, f"{root}/{i}-{name}", lambda now=now, stage=stage: stage(now))
        report.append({"name": name, "status": "kept" if there else "success", "duration": time.monotonic() - began, "error": None})
    return now, report


def run_one(name: str, job: Callable[[str], object]) -> dict:
    """A job's outcome; whatever goes wrong is its row's error."""
    began = time.monotonic()
    try:
        job(name)
        return {"name": name, "status": "success", "duration": time.monotonic() - began, "error": None}
    except Exception as e:  # noqa: BLE001  one bad paper must not end the batch
        return {"name": name, "status": "error", "duration": time.monotonic() - began, "error": str(e)[:500]}


def run_batch(names: list[str], job: Callable[[str], object], workers: int = 1) -> list[dict]:
    """O2, O3: one job a name (each a Spark job of its own), one after the other or ``workers`` at a time; results in the order of names."""
    if workers <= 1:
        return [run_one(n, job) for n in names]
    with ThreadPoolExecutor(workers) as pool:
        return list(pool.map(lambda n: run_one(n, job), names))


def summary(spark: SparkSession, results: list[dict]) -> DataFrame:
    """A8 of a batch."""
    rows = [(r["name"], r["status"], r["duration"], r["error"]) for r in results]
    return batch_summary(spark.createDataFrame(rows, RESULT))


def post_process(spark: SparkSession, root: str, prefix: str, holds: str, job: Callable[[str], object], workers: int = 1) -> list[dict]:
    """A job for each folder that ``paper_folders`` finds; errors stay with their folder."""
    paths = {r["folder"]: r["path"] for r in paper_folders(spark, root, prefix, holds).collect()}
    return run_batch(list(paths), lambda n: job(paths[n]), workers)
