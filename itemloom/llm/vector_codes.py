"""Operator 13, vector code compression with partial-distance search.

Vectors are cut into equal parts, and each part is named by its nearest entry
of that part's codebook (product quantisation), all in whole numbers.  The
nearest entry is found by partial-distance search: dimensions are taken in
descending variance over the codebook's entries, distances grow term by term,
and an entry is dropped as soon as what it has gathered strictly exceeds the
best complete distance known.  Masks drop entries for many vectors at once.

A round of training is one pass: tasks add up the parts of each entry, and
the sums (entries times dimensions) meet on the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .ann import matrix
from .skew import HEAVY, spread_join
from .staging import Staged

PARTS = 8
ENTRIES = 16
ROUNDS = 6
SCALE = 4096
#: Rows that are searched at once.
AT_ONCE = 1 << 14


def nearest_entry(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(entry, squared distance) of each row of x, ties to the lower entry, and the number of terms added.

    Two complete distances are known early: of the entry nearest in the first
    dimension, and of the one that leads after half of them.
    """
    n, dim = x.shape
    spread = len(book) * (book * book).sum(axis=0) - book.sum(axis=0) ** 2
    order = np.argsort(-spread, kind="stable")
    x, book = x[:, order], book[:, order]
    if not dim:
        return np.zeros(n, np.int64), np.zeros(n, np.int64), 0
    first = (x[:, :1] - book[None, :, 0]) ** 2
    lead = first.argmin(axis=1)
    best = ((x - book[lead]) ** 2).sum(axis=1)
    row, entry = np.nonzero(first <= best[:, None])
    sums, terms = first[row, entry], first.size + x.size
    for j in range(1, dim):
        sums = sums + (x[row, j] - book[entry, j]) ** 2
        terms += len(row)
        if j == dim // 2:
            start = np.searchsorted(row, np.arange(n))
            least = np.minimum.reduceat(sums, start)
            ahead = np.flatnonzero(sums == least[row])
            ahead = ahead[np.unique(row[ahead], return_index=True)[1]]
            best = np.minimum(best, ((x - book[entry[ahead]]) ** 2).sum(axis=1))
            terms += x.size
        alive = sums <= best[row]
        row, entry, sums = row[alive], entry[alive], sums[alive]
    start = np.searchsorted(row, np.arange(n))
    least = np.minimum.reduceat(sums, start)
    found = np.flatnonzero(sums == least[row])
    found = found[np.unique(row[found], return_index=True)[1]]
    return entry[found], least, terms


def coded(x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry of each part, squared distance over all parts) of the rows of x; ``books`` is parts x entries x dimensions."""
    width = books.shape[2]
    code, error = np.zeros((len(x), len(books)), np.int64), np.zeros(len(x), np.int64)
    for lo in range(0, len(x), AT_ONCE):
        some = slice(lo, lo + AT_ONCE)
        for p, book in enumerate(books):
            code[some, p], d, _ = nearest_entry(x[some, p * width : (p + 1) * width], book)
            error[some] += d
    return code, error


def sums(books) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """What a task adds to each entry: one row for each entry and position, with its sum and count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, entries, width = books.value.shape
        total, count = np.zeros((parts, entries, width), np.int64), np.zeros((parts, entries), np.int64)
        for batch in batches:
            x = matrix(batch.column("v"), parts * width)
            code, _ = coded(x, books.value)
            for p in range(parts):
                np.add.at(total[p], code[:, p], x[:, p * width : (p + 1) * width])
                count[p] += np.bincount(code[:, p], minlength=entries)
        at = np.arange(total.size, dtype=np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.ravel()), pa.array(np.repeat(count.ravel(), width))], names=["at", "s", "c"])

    return run


def trained(rows: DataFrame, books: np.ndarray, rounds: int) -> np.ndarray:
    """Codebooks after some rounds; an entry that no part uses stays."""
    spark = rows.sparkSession
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast(books)
        got = rows.select("v").mapInArrow(sums(sent), "at int, s long, c long").groupBy("at").agg(F.sum("s").alias("s"), F.sum("c").alias("c")).toArrow()
        total, count = np.zeros(books.size, np.int64), np.zeros(books.size, np.int64)
        at = got.column("at").to_numpy()
        total[at], count[at] = got.column("s").to_numpy(), got.column("c").to_numpy()
        books = np.where(count > 0, total // np.maximum(count, 1), books.ravel()).reshape(books.shape)
        sent.unpersist()
    return books


def whole_numbers(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", label: str = "label", scale: int = SCALE) -> DataFrame:
    """(vec_id, label, v) of the vectors that take part, components as floor(scale * x)."""
    v = F.col(vector)
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(label).alias("label"), v.alias("v")).where(F.col("v").isNotNull())
    rows = rows.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    return rows.withColumn("v", F.transform("v", lambda x: F.floor(x.cast("double") * scale).cast("long")))


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """Codes of all vectors under codebooks trained on all of them.

    Returns vec_id, code (two hexadecimal digits a part), error (squared
    distance to the coded vector), label_error (errors summed over the rows of
    the same label, nulls together) and codebooks_sha256.

    Vectors that are null or hold null or non-finite components take no part,
    nor do those of another length than most, or with components so large that
    a squared distance may not fit 64 bits.  A length that ``parts`` doesn't
    divide is filled up with zeros.  A codebook starts from the smallest
    vec_ids (null last, equal ones by their components); with fewer rows than
    ``entries`` it has as many entries as rows.  Repeated rows count each.  An
    empty table gives an empty table; other columns are not read.
    """
    spark = vectors.sparkSession
    staged = Staged(spark, "codes")
    rows = staged.put(whole_numbers(vectors, scale=scale))
    most = rows.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    out = StructType([vectors.schema["vec_id"], StructField("label", vectors.schema["label"].dataType), StructField("code", StringType())])
    if most is None:
        return spark.createDataFrame([], out).drop("label").selectExpr("vec_id", "code", "0L error", "0L label_error", "'' codebooks_sha256")
    dim = most["dim"]
    width = max(1, -(-dim // parts))
    bits = (62 - (parts * width - 1).bit_length()) // 2 - 1
    fits = F.forall("v", lambda x: (x < F.lit(1 << bits)) & (x > F.lit(-(1 << bits))))
    rows = rows.where((F.size("v") == dim) & fits)
    if parts * width > dim:
        rows = rows.withColumn("v", F.concat("v", F.array_repeat(F.lit(0).cast("long"), parts * width - dim)))
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).select("v").collect()
    if not first:
        return spark.createDataFrame([], out).drop("label").selectExpr("vec_id", "code", "0L error", "0L label_error", "'' codebooks_sha256")
    books = np.array([r["v"] for r in first], np.int64).reshape(len(first), parts, width).transpose(1, 0, 2)
    books = trained(rows, np.ascontiguousarray(books), rounds)
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    sent = spark.sparkContext.broadcast(books)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code, error = coded(matrix(batch.column("v"), parts * width), sent.value)
            hexed = pa.array([c.tobytes().hex() for c in code.astype(np.uint8)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), hexed, pa.array(error)], names=["vec_id", "label", "code", "error"])

    done = rows.mapInArrow(encode, StructType([*out.fields, StructField("error", LongType())]))
    done = staged.put(done.withColumn("lk", F.coalesce(F.concat(F.lit("s"), F.col("label").cast("string")), F.lit("n"))))
    labels = done.groupBy("lk").agg(F.sum("error").alias("label_error"), F.count("*").alias("c"))
    heavy = labels.where(F.col("c") * HEAVY > done.count())
    joined = spread_join(done, labels.drop("c"), ["lk"], heavy)
    return joined.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _part_sql(source: str, dim: int, parts: int) -> str:
    width = dim // parts
    return f"select vec_id, label, p, [v[p * {width} + j + 1] for j in range({width})] as x from {source}, (select unnest(range({parts})) as p)"


def codes_sql(dim: int = 64, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> str:
    """The same codes in SQL, one pair of steps for each round."""
    distance = "list_sum([(x[j] - y[j]) * (x[j] - y[j]) for j in range(1, len(x) + 1)])"
    steps = [
        f"""kept as materialized (
  select vec_id, label, [floor({SCALE}::double * e::double)::bigint for e in embedding] as v from embeddings
  where embedding is not null and len(embedding) = {dim} and len(list_filter(embedding, lambda e: e is null or not isfinite(e))) = 0),
cells as materialized ({_part_sql("kept", dim, parts)}),
book0 as materialized (
  select p, (row_number() over (partition by p order by vec_id) - 1)::int as e, x as y from cells qualify e < {entries})"""
    ]
    for r in range(rounds + 1):
        steps.append(
            f"""near{r} as materialized (
  select vec_id, p, min({{'d': d, 'e': e}}) as best from (select vec_id, p, e, {distance}::bigint as d from cells join book{r} using (p)) group by vec_id, p)"""
        )
        if r < rounds:
            steps.append(
                f"""sums{r} as materialized (
  select p, e, j, (t - ((t % c) + c) % c) // c as s from (
    select p, best.e as e, j, sum(x[j + 1])::bigint as t, count(*) as c from cells join near{r} using (vec_id, p), (select unnest(range({dim // parts})) as j)
    group by p, best.e, j)),
book{r + 1} as materialized (
  select b.p, b.e, coalesce(n.y, b.y) as y from book{r} b left join (select p, e, list(s order by j) as y from sums{r} group by p, e) n using (p, e))"""
            )
    return (
        "with "
        + ",\n".join(steps)
        + f""",
coded as (
  select vec_id, string_agg(printf('%02x', best.e), '' order by p) as code, sum(best.d)::bigint as error from near{rounds} group by vec_id),
digest as (
  select sha256(string_agg(array_to_string(y, ','), ',' order by p, e)) as codebooks_sha256 from book{rounds})
select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error, codebooks_sha256
from coded join kept using (vec_id), digest"""
    )


CODES_SQL = codes_sql()
