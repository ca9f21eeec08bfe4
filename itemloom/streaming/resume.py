"""Incremental processing with checkpoints (inventory O4, O5), and event-time windows on streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def file_stream(spark: SparkSession, path: str, schema: str, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def resume(stream: DataFrame, process: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Process what is new since the last call and stop; a batch that was redone replaces its own output."""

    def write(batch: DataFrame, epoch: int) -> None:
        process(batch).write.mode("overwrite").parquet(f"{out}/batch={epoch}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed(stream: DataFrame, length: str = "1 hour", late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Tumbling or sliding counts and sums by event type, with a watermark for late rows."""
    return windowed_on(stream.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late), "at", length, slide)


def windowed_on(rows: DataFrame, at: str, length: str = "1 hour", slide: str | None = None) -> DataFrame:
    """The same over rows that have their watermark already."""
    span = F.window(at, length, slide) if slide else F.window(at, length)
    return rows.groupBy(span.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(rows: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Session windows by user."""
    return rows.withColumn("at", F.col("ts").cast("timestamp")).groupBy(F.session_window("at", gap).alias("s"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("s.start").alias("start"), "n")
