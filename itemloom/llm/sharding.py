"""Operator 8, sharding by sampled splitters, to near-equal bytes.

Equal texts are a unit and share a shard, unless the group is so large that it
would fill a good part of one; then its rows are units of their own.  Units
above a 64th of a shard (so at most 64 for each shard) are dealt largest
first to the emptiest shard.  The others are range-partitioned by key: a
size-weighted sample gives splitters at its quantiles, ranges that came out
overfull are subdivided, and running sums over ranges and inside them give
every unit its place; cuts at the shards' remaining room finish the job.

All of it is DataFrame functions; what reaches the driver is bounded by the
number of shards and splitters.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .staging import Staged

SHARDS = 24
#: A group of equal texts above this part of a shard is divided.
WHOLE = 4
#: Units above this part of a shard are dealt one by one.
FINE = 64
#: Sampled keys for each range.
OVERSAMPLE = 16
PARTS = 512


def keys(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.xxhash64(text).alias("h"),
        F.monotonically_increasing_id().alias("uid"),
    )


def numbered(rows: DataFrame) -> DataFrame:
    """Rows with ``g``, a different one for each: hash of doc_id and of the place among rows of that id and text.

    Places are counted in two levels (parts that one task has written, then
    inside a part), so rows that all lack an id are many window partitions.
    They are the same set however the rows are dealt.
    """
    rows = rows.withColumns({"same": F.coalesce("doc_id", F.lit(-(1 << 63))), "cell": F.shiftright("uid", 33)})
    by = ["h", "text_crc32", "size", "same"]
    before = Window.partitionBy(*by).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    first = rows.groupBy(*by, "cell").agg(F.count("*").alias("c")).select(*by, "cell", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("first"))
    nth = F.row_number().over(Window.partitionBy(*by, "cell").orderBy("uid"))
    rows = rows.withColumn("nth", nth).join(first, [*by, "cell"])
    return rows.withColumn("g", F.xxhash64("doc_id", F.col("first") + F.col("nth"))).drop("same", "cell", "nth", "first")


KEY = ["h", "text_crc32", "size", "g"]


def range_of(splitters: list[tuple[int, int]]) -> Column:
    """How many splitters are at or below the key (h, g), by binary search."""
    n = len(splitters)
    if not n:
        return F.lit(0)
    hs, gs = F.lit([h for h, _ in splitters]), F.lit([g for _, g in splitters])
    key_h, key_g = F.col("h"), F.col("g")

    def step(acc: Column, _: Column) -> Column:
        mid = F.shiftright(acc.lo + acc.hi, 1)
        at_h, at_g = F.get(hs, mid), F.get(gs, mid)
        below = (acc.lo < acc.hi) & ((at_h < key_h) | ((at_h == key_h) & (at_g <= key_g)))
        return F.struct(
            F.when(below, mid + 1).otherwise(acc.lo).alias("lo"),
            F.when(below, acc.hi).otherwise(F.when(acc.lo < acc.hi, mid).otherwise(acc.hi)).alias("hi"),
        )

    begin = F.struct(F.lit(0).alias("lo"), F.lit(n).alias("hi"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(n.bit_length())), begin, step, lambda acc: acc.lo)


def dealt(large: list, shards: int) -> tuple[list[tuple], list[int]]:
    """Largest first to the emptiest shard; at most FINE * shards units by construction."""
    heap = [(0, s) for s in range(shards)]
    out = []
    for u in sorted(large, key=lambda u: (-u["b"], u["h"], u["text_crc32"], u["g"])):
        load, s = heapq.heappop(heap)
        out.append((u["h"], u["text_crc32"], u["size"], u["g"], s))
        heapq.heappush(heap, (load + u["b"], s))
    return out, [load for load, _ in sorted(heap, key=lambda x: x[1])]


def room(loads: list[int], rest: int) -> list[float]:
    """Cuts of the running sum: each shard is filled up to one common level."""
    order = sorted(loads)
    level = 0.0
    for k in range(len(order), 0, -1):
        level = (rest + sum(order[:k])) / k
        if k == 1 or level >= order[k - 1]:
            break
    cuts, total = [], 0.0
    for load in loads:
        total += max(0.0, level - load)
        cuts.append(total)
    return cuts


def shard_by_bytes(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Deal all rows to ``shards`` shards of near-equal bytes (text bytes plus 8 a row).

    Returns doc_id, size, text_crc32, law ('bytes'), shard, slot (gapless from
    0 in each shard) and grown_shard (null: this law moves rows when the
    number of shards changes).  Reruns agree.

    A null text has 0 bytes and the crc32 of nothing; a very long text is one
    unit, so no shard can be smaller than the longest.  Null doc_ids and
    repeated rows are rows like any other, also where a huge group has no
    others.  With fewer rows than shards some
    shards stay empty; an empty table gives an empty table; other columns are
    not read.
    """
    spark = docs.sparkSession
    staged = Staged(spark, "sharding")
    rows = staged.put(keys(docs))
    total, n = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    fair = total / shards
    groups = rows.groupBy("h", "text_crc32", "size").agg(F.count("*").alias("c"))
    # at most WHOLE * shards groups by bytes and as many by rows
    huge = groups.where((F.col("c") * F.col("size") > fair / WHOLE) | (F.col("c") > max(1.0, n / (WHOLE * shards)))).select("h", "text_crc32", "size", F.lit(True).alias("apart"))
    rows = rows.join(F.broadcast(huge), ["h", "text_crc32", "size"], "left")
    apart = numbered(rows.where("apart").drop("apart")).select("doc_id", *KEY)
    rows = rows.where("apart is null").select("doc_id", *KEY[:3], F.lit(0).cast("long").alias("g")).unionByName(apart)
    rows = staged.put(rows)
    units = staged.put(rows.groupBy(*KEY).agg(F.sum("size").alias("b")))
    is_large = F.col("b") > fair / FINE
    placed_large, loads = dealt(units.where(is_large).collect(), shards)
    small = units.where(~is_large)
    rest = total - sum(loads)
    cuts = room(loads, rest)
    ranges = max(4 * shards, int(spark.conf.get("spark.sql.shuffle.partitions")))
    chance = F.col("b") * (ranges * OVERSAMPLE / max(rest, 1))
    drawn = small.where(F.pmod(F.xxhash64("g", "h", F.lit("draw")), F.lit(1 << 40)) < chance * (1 << 40)).select("h", "g")
    drawn = drawn.withColumn("i", F.row_number().over(Window.orderBy("h", "g")))
    splitters = [(r["h"], r["g"]) for r in drawn.where(F.col("i") % OVERSAMPLE == 0).orderBy("i").collect()]
    small = small.withColumn("range", range_of(splitters))
    filled = small.groupBy("range").agg(F.sum("b").alias("rb"))
    mean = max(rest / (len(splitters) + 1), 1.0)
    cells = filled.select("range", F.when(F.col("rb") > 2 * mean, F.ceil(F.col("rb") / mean)).otherwise(1).alias("cells"))
    small = small.join(F.broadcast(cells), "range").withColumn("sub", F.pmod(F.xxhash64("h", "g"), F.col("cells")))
    small = staged.put(small.drop("cells"))
    sums = small.groupBy("range", "sub").agg(F.sum("b").alias("s"))
    ahead = Window.orderBy("range", "sub").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("range", "sub", F.coalesce(F.sum("s").over(ahead), F.lit(0)).alias("before"))
    inside = Window.partitionBy("range", "sub").orderBy(*KEY).rowsBetween(Window.unboundedPreceding, 0)
    middle = F.col("before") + F.sum("b").over(inside) - F.col("b") / 2
    full = F.size(F.filter(F.lit(cuts), lambda c: c <= F.col("mid")))
    small = small.join(F.broadcast(sums), ["range", "sub"]).withColumn("mid", middle)
    placed = small.select(*KEY, F.least(full, F.lit(shards - 1)).alias("shard"))
    if placed_large:
        placed = placed.unionByName(spark.createDataFrame(placed_large, "h long, text_crc32 long, size long, g long, shard int"))
    rows = staged.put(rows.join(placed, KEY).withColumn("part", F.pmod(F.xxhash64("doc_id", "h", "g"), F.lit(PARTS))))
    counts = rows.groupBy("shard", "part").agg(F.count("*").alias("c"))
    over = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("shard", "part", F.coalesce(F.sum("c").over(over), F.lit(0)).alias("first"))
    nth = F.row_number().over(Window.partitionBy("shard", "part").orderBy("doc_id", "h", "size"))
    # the counts have at most shards * PARTS rows
    out = rows.withColumn("nth", nth).join(F.broadcast(counts), ["shard", "part"])
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("first") + F.col("nth") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
