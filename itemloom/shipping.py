"""Makes this package importable in Python workers wherever the driver found it."""

from __future__ import annotations

import os
import sys
import tempfile
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark import cloudpickle
from pyspark.sql import SparkSession

_DONE: set[str] = set()
#: Bytes of an Arrow batch on its way to a Python worker, unless the session says otherwise.
BATCH_BYTES = 8 << 20
_BATCH_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


def ship(spark: SparkSession) -> None:
    """Send the package's sources to the workers, once for each application, and bound Arrow batches by bytes."""
    sc = spark.sparkContext
    if spark.conf.get(_BATCH_KEY, None) in (None, "67108864b", str(64 << 20)):
        spark.conf.set(_BATCH_KEY, str(BATCH_BYTES))
    if sc.applicationId in _DONE:
        return
    home = Path(__file__).resolve().parent
    handle, name = tempfile.mkstemp(prefix="itemloom-", suffix=".zip")
    with os.fdopen(handle, "wb") as out, zipfile.ZipFile(out, "w") as z:
        for p in sorted(home.rglob("*.py")):
            z.write(p, p.relative_to(home.parent))
    sc.addPyFile(name)
    _DONE.add(sc.applicationId)


@contextmanager
def by_value() -> Iterator[None]:
    """Inside, what is pickled of this package goes whole.

    The Python processes that plan data sources and stateful streams beside
    the driver do not get shipped sources.
    """
    package = sys.modules[__package__]
    cloudpickle.register_pickle_by_value(package)
    try:
        yield
    finally:
        cloudpickle.unregister_pickle_by_value(package)
