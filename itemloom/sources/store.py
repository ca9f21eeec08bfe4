"""Tables that are there whole or not at all (inventory S24, O1, S13-S19).

A commit writes its rows below a folder of its own and then one manifest:
files with their sizes, number of rows, a digest of the rows, the schema.
Readers trust the manifest alone.  A folder without one, or with other files
than it lists, is not a table: a job that was cut off is made again.

The number of rows and the digest are gathered while the rows are written;
nothing is read twice for them.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, StructType, VariantType

from ..shared import Store

MANIFEST = "_manifest.json"


@dataclass
class Manifest:
    """What a commit holds."""

    folder: str
    files: dict[str, int]
    rows: int
    digest: str
    schema: str


def row_digest(df: DataFrame) -> Column:
    """The sum of the rows' hashes, whatever their order; columns that can't be hashed (maps, variants) are left out."""
    good = [f.name for f in df.schema.fields if not isinstance(f.dataType, MapType | VariantType)]
    hashed = F.xxhash64(*[F.col(f"`{c}`") for c in good]) if good else F.lit(0)
    return F.coalesce(F.sum(hashed.cast("decimal(38,0)")), F.lit(0)).cast("string")


def commit(rows: DataFrame, path: str) -> Manifest:
    """Write rows and make them the table at ``path``; one that is there is replaced by the new manifest, not before."""
    store = Store(rows.sparkSession)
    folder, seen = f"data-{uuid.uuid4().hex[:12]}", Observation()
    rows.observe(seen, F.count(F.lit(1)).alias("n"), row_digest(rows).alias("digest")).write.parquet(f"{path}/{folder}")
    manifest = Manifest(folder, store.sizes(f"{path}/{folder}"), seen.get["n"], seen.get["digest"], rows.schema.json())
    before = read(store, path)
    store.put(f"{path}/{MANIFEST}", json.dumps(asdict(manifest)))
    if before is not None:
        store.delete(f"{path}/{before.folder}")
    return manifest


def read(store: Store, path: str) -> Manifest | None:
    """What the manifest says; None where there is none, or a torn one."""
    text = store.text(f"{path}/{MANIFEST}")
    try:
        return None if text is None else Manifest(**json.loads(text))
    except (ValueError, TypeError):
        return None


def manifest_of(spark: SparkSession, path: str) -> Manifest | None:
    """The table's manifest, if all that it lists is there in the listed size and nothing else."""
    store = Store(spark)
    found = read(store, path)
    return found if found is not None and store.sizes(f"{path}/{found.folder}") == found.files else None


def table(spark: SparkSession, path: str) -> DataFrame | None:
    """The committed rows, or None where there is no whole table."""
    found = manifest_of(spark, path)
    if found is None:
        return None
    return spark.read.schema(StructType.fromJson(json.loads(found.schema))).parquet(f"{path}/{found.folder}")


def kept(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> tuple[DataFrame, bool]:
    """(the table at ``path``, whether it was there already); made and committed where it was not."""
    found = table(spark, path)
    if found is not None:
        return found, True
    commit(make(), path)
    return table(spark, path), False


def intact(spark: SparkSession, path: str) -> bool:
    """Reads the rows again and holds them against the manifest: their number and digest."""
    found, rows = manifest_of(spark, path), table(spark, path)
    if found is None or rows is None:
        return False
    now = rows.agg(F.count(F.lit(1)).alias("n"), row_digest(rows).alias("digest")).first()
    return (now["n"], now["digest"]) == (found.rows, found.digest)
