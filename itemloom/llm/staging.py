"""Intermediate tables in the shared folder, and freeing what is no longer read."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..shared import shared_folder
from ..shipping import ship
from .memory import give_back


class Staged:
    """Tables written to the shared folder by one operator call.

    Every table is complete when its ``put`` returns, so a lost executor costs
    the tasks that read it, not the lineage before it.
    """

    def __init__(self, spark: SparkSession, name: str):
        ship(spark)
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self.count = 0

    def put(self, df: DataFrame) -> DataFrame:
        self.count += 1
        path = f"{self.root}/{self.count}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._staged_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete staged tables that nothing reads any more, and let Spark free finished shuffles."""
        jvm = self.spark.sparkContext._jvm
        for t in tables:
            path = jvm.org.apache.hadoop.fs.Path(t._staged_path)
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        self.free()

    def free(self) -> None:
        give_back(self.spark)
