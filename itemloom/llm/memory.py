"""Returning memory that is free but still held, between the steps of one process."""

from __future__ import annotations

import ctypes
import gc

import pyarrow as pa
from pyspark.sql import SparkSession


def give_back(spark: SparkSession | None = None) -> None:
    """Hand freed memory of this Python process (and of the driver's JVM, if ``spark`` is given) back to the system.

    The C library keeps what large arrays of a training occupied; without this
    a driver that runs several operators carries the largest one's peak along.
    Where the C library has no ``malloc_trim`` that part is left out.
    """
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)
    if spark is not None:
        spark.sparkContext._jvm.System.gc()
