"""Operator 4, mixing sources to target weights by a low-discrepancy schedule.

The mix is a row of slots, each one block of equally many words.  Golden-ratio
points, mapped through the cumulative target weights, name each slot's source;
slots are ranked per source.  A source's documents, in a hashed order and end
to end, are cut into blocks, and block r goes to the source's slot of rank r.
So the number of points that fall to a source decides how many words it
gives: its target within the discrepancy of the sequence, a few blocks.
Sources whose target is above their size are passed through again.

All of it is DataFrame functions.  Rankings and running sums are taken in two
levels (sorted or hashed parts, then inside a part), so neither many sources
nor one source with a third of all rows meets in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .staging import Staged

WORD = r"[^\x20\x09-\x0D]+"
GOLDEN = 0.6180339887498949
#: Slots of the schedule: at least so many in all, and so many for each source; a block has as many words as that needs, one at least.
SLOTS = 1 << 20
PER_SOURCE = 512
#: Stretches of the schedule in which slots are ranked apart.
CELLS = 1 << 12
#: Strips of the mix, by which points and sources meet.
STRIPS = 1 << 14
MOST = 3
WEIGHTS = (1, 2, 3)
#: Sources whose figures are broadcast at most; with more, rows are salted and joined.
BROADCAST_SOURCES = 50_000
SALTS = 64


def source_key(source: str | Column = "source") -> Column:
    """The source, told apart from null."""
    col = F.col(source) if isinstance(source, str) else source
    return F.coalesce(F.concat(F.lit("s"), col.cast("string")), F.lit("n"))


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, sk, size, o: place in the hashed order, k_text, n): wholly repeated rows are one row counted n times."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        source_key().alias("sk"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.md5(text)), F.lit(":mix"))).alias("o"),
        F.xxhash64(text).alias("k_text"),
    )
    return rows.groupBy(*rows.columns).agg(F.count("*").alias("n"))


def in_order(df: DataFrame, staged: Staged, *keys: Column | str) -> DataFrame:
    """Stored in the order of the keys: ``at`` grows with the order, ``part`` is the sorted part that a row lies in."""
    rows = df.orderBy(*keys).withColumn("at", F.monotonically_increasing_id())
    return staged.put(rows.withColumn("part", F.shiftright("at", 33)))


def running(ordered: DataFrame, **sums: Column | str) -> DataFrame:
    """Running sums, the row itself included, over rows from ``in_order``; one row per part meets in one task."""
    cols = {k: (F.col(v) if isinstance(v, str) else v) for k, v in sums.items()}
    ordered = ordered.withColumns({f"{k}_": v for k, v in cols.items()})
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = ordered.groupBy("part").agg(*[F.sum(f"{k}_").alias(f"{k}_sum") for k in cols])
    parts = parts.select("part", *[F.coalesce(F.sum(f"{k}_sum").over(before), F.lit(0)).alias(f"{k}_before") for k in cols])
    inside = Window.partitionBy("part").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    ordered = ordered.withColumns({f"{k}_": F.sum(f"{k}_").over(inside) for k in cols})
    joined = ordered.join(F.broadcast(parts), "part")  # as many rows as sorted parts
    return joined.withColumns({k: F.col(f"{k}_before") + F.col(f"{k}_") for k in cols}).drop(*[f"{k}{e}" for k in cols for e in ("_", "_before")])


def targets(rows: DataFrame, staged: Staged, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(sk, source_size, target) by water filling: targets follow the weights up to ``most`` times the size.

    One row per source; sources by code point, null last.
    """
    sizes = rows.groupBy("sk").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    named = running(in_order(sizes, staged, F.col("sk") == "n", "sk"), nth=F.lit(1))
    weight = F.element_at(F.lit(list(weights)), ((F.col("nth") - 1) % len(weights) + 1).cast("int")).cast("double")
    caps = named.select("sk", "source_size", weight.alias("weight"), (F.col("source_size") * most).cast("double").alias("cap"))
    early = running(in_order(caps, staged, F.col("cap") / F.col("weight"), "sk"), caps_to="cap", weights_to="weight")
    early = staged.put(early)
    total, weigh = early.agg(F.sum("source_size"), F.sum("weight")).first()
    # the level if this source were the first, in order of cap by weight, that is not full
    level = (F.lit(float(total or 0)) - (F.col("caps_to") - F.col("cap"))) / (F.lit(float(weigh or 1)) - (F.col("weights_to") - F.col("weight")))
    first = early.withColumn("level", level).where(F.col("level") * F.col("weight") <= F.col("cap")).orderBy("at").select("level").first()
    fill = F.col("cap") if first is None else F.least(F.lit(first["level"]) * F.col("weight"), F.col("cap"))
    return early.select("sk", "source_size", fill.alias("target"))


def points(spark, slots: int, total: int) -> DataFrame:
    """(slot, pos): the sequence's points as word positions of the mix."""
    x = F.col("id") * F.lit(GOLDEN) % F.lit(1.0)
    return spark.range(slots).select(F.col("id").alias("slot"), F.floor(x * F.lit(float(total))).cast("long").alias("pos"))


def schedule(goals: DataFrame, staged: Staged, most_slots: int | None = None) -> tuple[DataFrame, DataFrame, int]:
    """(slots, sources, block): slots (sk, rank, slot), sources (sk, source_size, target, k, take), words of a block.

    ``goals`` has sk, source_size and target.  Without ``most_slots`` the slots
    grow with the sources, so that each has enough to come near its target.  A
    source with a target but no point has one slot at the end, of its target's
    words.
    """
    goals = goals.withColumn("goal", F.floor(F.col("target") + 0.5).cast("long"))
    total, count = goals.agg(F.coalesce(F.sum("goal"), F.lit(0)), F.count_if(F.col("goal") > 0)).first()
    block = max(1, -(-total // (most_slots or max(SLOTS, PER_SOURCE * count))))
    slots = -(-total // block)
    strip = max(1, -(-total // STRIPS))
    arcs = running(in_order(goals.where("goal > 0"), staged, F.col("sk") == "n", "sk"), hi="goal").withColumn("lo", F.col("hi") - F.col("goal"))
    arcs = arcs.select("sk", "lo", "hi", F.explode(F.sequence(F.expr(f"lo div {strip}"), F.expr(f"(hi - 1) div {strip}"))).alias("strip"))
    dots = points(goals.sparkSession, slots, total).withColumn("strip", F.expr(f"pos div {strip}"))
    named = dots.join(arcs, "strip").where("pos >= lo and pos < hi").select("sk", "slot")
    named = staged.put(named.withColumn("cell", F.expr(f"slot div {max(1, -(-slots // CELLS))}")))
    cells = named.groupBy("sk", "cell").agg(F.count("*").alias("c"))
    over = Window.partitionBy("sk").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)  # at most CELLS rows a source
    cells = cells.select("sk", "cell", F.coalesce(F.sum("c").over(over), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("sk", "cell").orderBy("slot")) - 1
    named = staged.put(named.withColumn("inside", inside).join(cells, ["sk", "cell"]).select("sk", (F.col("before") + F.col("inside")).alias("rank"), "slot"))
    count = named.groupBy("sk").agg(F.count("*").alias("k"))
    take = F.when(F.col("k").isNull(), F.col("goal")).otherwise(F.least(F.col("k") * block, F.col("source_size") * MOST))
    sources = staged.put(goals.join(count, "sk", "left").select("sk", "source_size", "target", F.coalesce("k", F.lit(0)).alias("k"), take.alias("take")))
    missed = sources.where("k = 0 and take > 0").select("sk", F.lit(0).cast("long").alias("rank"), F.lit(slots).cast("long").alias("slot"))
    return named.unionByName(missed), sources, block


def with_source(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """Rows (with sk and o) with their source's figures; no task takes a whole source."""
    if sources.count() <= BROADCAST_SOURCES:
        return rows.join(F.broadcast(sources), "sk")
    salted = sources.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64("o"), F.lit(SALTS)).cast("int")).join(salted, ["sk", "salt"]).drop("salt")


def positions(rows: DataFrame) -> DataFrame:
    """Rows, repeated ones one by one, with ``start``: words of the same source before them in the hashed order."""
    rows = rows.withColumn("cell", F.substring("o", 1, 3))
    sums = rows.groupBy("sk", "cell").agg(F.sum(F.col("size") * F.col("n")).alias("s"))
    over = Window.partitionBy("sk").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)  # at most 4,096 cells a source
    sums = sums.select("sk", "cell", F.coalesce(F.sum("s").over(over), F.lit(0)).alias("before"))
    inside = Window.partitionBy("sk", "cell").orderBy("o", "doc_id", "size", "k_text").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("upto", F.sum(F.col("size") * F.col("n")).over(inside)).join(sums, ["sk", "cell"])
    first = F.col("before") + F.col("upto") - F.col("size") * F.col("n")
    rows = rows.withColumn("first", first).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    return rows.select("doc_id", "sk", "o", "size", "k_text", (F.col("first") + (F.col("copy") - 1) * F.col("size")).alias("start"))


def block_pieces(placed: DataFrame, slots: DataFrame, block: int, most: int = MOST) -> DataFrame:
    """(sk, start, pass, slot, words): what each slot takes of each document, joined by (source, block)."""
    rows = placed.where("size > 0").withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(most - 1))))
    rows = rows.withColumn("lo", F.col("pass") * F.col("source_size") + F.col("start")).where("lo < take")
    rows = rows.withColumn("hi", F.least(F.col("lo") + F.col("size"), F.col("take")))
    rows = rows.withColumn("rank", F.explode(F.sequence(F.expr(f"lo div {block}"), F.expr(f"(hi - 1) div {block}"))))
    rows = rows.withColumn("words", F.expr(f"least(hi, (rank + 1) * {block}) - greatest(lo, rank * {block})"))
    return rows.join(slots, ["sk", "rank"]).select("sk", "start", "pass", "slot", "words")


def parts(docs: DataFrame, slots: int | None) -> tuple[DataFrame, DataFrame]:
    """(rows with start and their source's figures, pieces)."""
    staged = Staged(docs.sparkSession, "mixing")
    rows = staged.put(sized(docs))
    named, sources, block = schedule(targets(rows, staged), staged, slots)
    placed = staged.put(with_source(positions(rows), sources))
    return placed, block_pieces(placed, named, block)


def mix(docs: DataFrame, slots: int | None = None) -> DataFrame:
    """How many words of each document the mix takes.

    Returns doc_id, size, source_size, target, taken and first_slot (null if
    nothing is taken).  A source's taken words are its slots times the words
    of a block: its target within a few blocks, a block being a ``slots``-th
    of all words (by default ``SLOTS`` or ``PER_SOURCE`` for each source,
    whatever is more).  Each whole pass takes every word of a document once, and
    there are three passes at most.

    Null or empty texts have size 0 and are never taken; long texts are spread
    over as many blocks as they fill.  A null source is a source of its own,
    the last one.  Null doc_ids and repeated rows are rows like any other.  An
    empty table gives an empty table; other columns are not read.
    """
    placed, pieces = parts(docs, slots)
    taken = pieces.groupBy("sk", "start").agg(F.sum("words").alias("taken"), F.min("slot").alias("first_slot"))
    some = placed.where("size > 0").join(taken, ["sk", "start"], "left")
    none = placed.where("size = 0").select("*", F.lit(None).cast("long").alias("taken"), F.lit(None).cast("long").alias("first_slot"))
    out = some.unionByName(none)
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "first_slot")


def mixed(docs: DataFrame, slots: int | None = None) -> DataFrame:
    """The mix as whole documents in slot order, columns unchanged: one row for each pass that takes a document.

    Of the document in which a source's last pass ends, half or more is
    rounded up to all of it and less to none.  Rows alike in doc_id, source
    and text count as one row repeated.  Null and empty texts are never taken;
    a very long one comes whole or not at all; ties of slots go by id.  An
    empty table gives an empty table.
    """
    placed, pieces = parts(docs, slots)
    passes = pieces.groupBy("sk", "start", "pass").agg(F.sum("words").alias("words"), F.min("slot").alias("slot"))
    passes = passes.join(placed.where("size > 0").select("sk", "start", "doc_id", "k_text", "size"), ["sk", "start"]).where("2 * words >= size")
    passes = passes.select(F.coalesce("doc_id", F.lit(-1)).alias("m_id"), F.col("sk").alias("m_sk"), F.col("k_text").alias("m_text"), F.col("slot").alias("m_slot"))
    rows = docs.select(F.struct("*").alias("m_row"))
    rows = rows.select("m_row", F.coalesce(F.col("m_row.doc_id").cast("long"), F.lit(-1)).alias("m_id"), source_key(F.col("m_row.source")).alias("m_sk"), F.xxhash64(F.coalesce(F.col("m_row.text"), F.lit(""))).alias("m_text"))
    on = ["m_id", "m_sk", "m_text"]
    one = rows.groupBy(*on).agg(F.first("m_row").alias("m_row"))
    return passes.join(one, on).orderBy("m_slot", *on).select("m_row.*")


#: The same numbers from the same schedule.
MIX_SQL = f"""
with sized as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::bigint as size,
         md5(coalesce(doc_id::varchar, md5(coalesce(text, ''))) || ':mix') as o, text
  from documents),
sources as (
  select source, sum(size)::bigint as source_size from sized group by source),
weighted as (
  select *, ((row_number() over (order by source nulls last) - 1) % 3 + 1)::double as weight,
         (3 * source_size)::double as cap from sources),
levels as (
  select *, ((select sum(source_size) from sources)
             - coalesce(sum(cap) over (order by cap / weight, source nulls last rows between unbounded preceding and 1 preceding), 0))
            / sum(weight) over (order by cap / weight, source nulls last rows between current row and unbounded following) as level
  from weighted),
fill as (
  select level from levels where level * weight <= cap order by cap / weight, source nulls last limit 1),
goals as (
  select source, source_size, coalesce(least((select level from fill) * weight, cap), cap) as target from levels),
arcs as (
  select *, floor(target + 0.5)::bigint as goal, (sum(floor(target + 0.5)::bigint) over (order by source nulls last rows unbounded preceding))::bigint as hi from goals),
whole as (
  select coalesce(sum(goal), 0)::bigint as total, greatest(1, (coalesce(sum(goal), 0)::bigint + greatest({SLOTS}, {PER_SOURCE} * count_if(goal > 0))::bigint - 1) // greatest({SLOTS}, {PER_SOURCE} * count_if(goal > 0))::bigint) as block from arcs),
slots as (
  select unnest(range(0, ((total + block - 1) // block)::bigint)) as slot, total from whole),
dots as (
  select slot, floor((slot * {GOLDEN}::double % 1.0::double) * total::double)::bigint as pos from slots),
counted as (
  select a.source, count(*) as k from dots d join arcs a on d.pos >= a.hi - a.goal and d.pos < a.hi group by 1),
takes as (
  select a.source, a.source_size, a.target,
         case when c.k is null then a.goal else least(c.k * (select block from whole), 3 * a.source_size) end as take
  from arcs a left join counted c on a.source is not distinct from c.source),
placed as (
  select *, (sum(size) over (partition by source order by o, doc_id, size, text rows unbounded preceding))::bigint - size as start from sized)
select p.doc_id, p.size, g.source_size, g.target,
       (greatest(0, least(p.size, g.take - p.start))
        + greatest(0, least(p.size, g.take - p.start - g.source_size))
        + greatest(0, least(p.size, g.take - p.start - 2 * g.source_size)))::bigint as taken
from placed p join takes g on p.source is not distinct from g.source
"""
