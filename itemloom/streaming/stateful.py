"""Streams with state: tagging that reopens failed batches by timer, and rows that come late (inventory O4, O5, E12).

State lives in Spark's state store (RocksDB, checkpointed with the stream), so
a stream that was killed goes on where it was: an item is handed out once, and
an item whose model call failed stays open until a timer asks again.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from ..operators.enrich import BATCH, Provider
from ..shared import Store

#: Settings of the state store that a session gets unless it has its own: on disk, with one bound for all stores of an executor; a batch saves what it changed, not each store as a whole.
STATE = {
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "200",
}
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
TAGGED = "paper_id string, item string, subject string, topic string, difficulty string, tag_status string, tries int"
TAG = Row(*[f.split()[0] for f in TAGGED.split(", ")])
#: State of a paper's items, as types: a text would be parsed by the JVM in every task.
ITEM = StructType([StructField("item", StringType())])
DONE = StructType([StructField("at", LongType())])
EARLY = StructType([StructField("items", ArrayType(StringType()))])
OPEN = StructType([StructField("text", StringType()), StructField("tries", IntegerType())])
#: So many items of a paper are remembered by the call, and read again together; the rest one by one.
FEW = 1000
#: Tags of an item that was given up (decision B12).
DEFAULTS = {"subject": "Unknown", "topic": "Unknown", "difficulty": "medium"}


class Tagging(StatefulProcessor):
    """Tags of a paper's items.

    New items go to the provider in batches of ``size``.  Where a call fails or
    leaves an item out, the item is kept open, and a timer asks again for each
    open item alone after ``wait`` seconds, doubled with every try; so one bad
    item can't hold up the nine beside it.  After ``attempts`` tries it is
    given up with status 'failed'.

    Each read or change of the state is a round trip to the JVM, which costs
    more than all else.  So a new paper is known by three of them, and its
    first ``FEW`` items are remembered with one for each call of the provider.
    """

    def __init__(self, provider: Provider, size: int = BATCH, wait: float = 2.0, attempts: int = 3, keep_ms: int | None = None):
        self.provider, self.size, self.wait, self.attempts, self.keep_ms = provider, size, wait, attempts, keep_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.done = handle.getMapState("done", ITEM, DONE, self.keep_ms)
        self.early = handle.getMapState("early", ITEM, EARLY, self.keep_ms)
        self.open = handle.getMapState("open", ITEM, OPEN)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        early = {item for (items,) in self.early.values() for item in items}
        known = [state for state in (self.done, self.open) if state.exists()]
        fresh: dict[str, str] = {}
        for r in rows:
            if r.item not in fresh and r.item not in early and not any(state.containsKey((r.item,)) for state in known):
                fresh[r.item] = r.text
        yield from self.asked(key[0], [(i, t, 0) for i, t in fresh.items()], self.size, timerValues, FEW - len(early))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: ARG002
        waiting = [(k[0], v[0], v[1]) for k, v in self.open.iterator()]
        self.open.clear()
        yield from self.asked(key[0], waiting, 1, timerValues)

    def asked(self, paper: str, items: list[tuple[str, str, int]], size: int, timers, room: int = 0) -> Iterator[Row]:
        """``room``: for so many items the state of the paper's first ones has room."""
        now, out, again = timers.getCurrentProcessingTimeInMs(), [], 0.0
        for lo in range(0, len(items), size):
            some = items[lo : lo + size]
            tags, closed = self.tags([t for _, t, _ in some]), []
            for i, (item, text, tries) in enumerate(some):
                tag, tries = tags.get(i), tries + 1
                if tag is None and tries < self.attempts:
                    self.open.updateValue((item,), (text, tries))
                    again = max(again, self.wait * 2 ** (tries - 1))
                    continue
                closed.append(item)
                tag = {**DEFAULTS, **{k: v for k, v in (tag or {}).items() if v is not None}}
                out.append(TAG(paper, item, tag["subject"], tag["topic"], tag["difficulty"], "ok" if tags.get(i) else "failed", tries))
            if closed and len(closed) <= room:
                self.early.updateValue((closed[0],), (closed,))
                room -= len(closed)
            else:
                for item in closed:
                    self.done.updateValue((item,), (now,))
        if again:
            self.handle.registerTimer(now + int(1000 * again))
        yield from out

    def tags(self, texts: list[str]) -> dict[int, dict]:
        """Answers by position; nothing where the call fails or answers otherwise."""
        try:
            got = json.loads(self.provider.complete("TAG\n" + json.dumps([{"id": i, "text": t} for i, t in enumerate(texts)])))
            return {r["id"]: r for r in got if isinstance(r, dict) and "id" in r}
        except Exception:  # noqa: BLE001  any failure of an outside service leaves its items open
            return {}

    def close(self) -> None:
        pass


def tagging(stream: DataFrame, provider: Provider, key: list[str], text: str = "question_text", **settings) -> DataFrame:
    """E12 on a stream of items (paper_id, the key's columns, a text): each item's tags once, as soon as the provider gives them.

    ``item`` is the key as JSON text.  ``settings`` are those of ``Tagging``.
    An item that comes again is not tagged again (for ``keep_ms``, if given).

    Spark runs no batch, and so no timer, where a stream starts again after a
    whole batch and nothing new has come: the ticks beside the stream, of
    which no row is taken, make it run.
    """
    from ..shipping import by_value, ship

    spark = stream.sparkSession
    ship(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    for name, value in STATE.items():
        if spark.conf.get(name, None) is None:
            spark.conf.set(name, value)
    rows = stream.select("paper_id", F.to_json(F.struct(*key)).alias("item"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    ticks = spark.readStream.format("rate").load().where(F.lit(False))
    rows = rows.union(ticks.select(*[F.lit(None).cast("string").alias(c) for c in rows.columns]))
    with by_value():
        return rows.groupBy("paper_id").transformWithState(Tagging(provider, **settings), StructType.fromDDL(TAGGED), "Append", "ProcessingTime")


def until(query: StreamingQuery, done: Callable[[], bool], seconds: float = 300, pause: float = 0.2) -> None:
    """Let a stream run until ``done`` (or it ends by itself), then stop it; ``seconds`` without a change of its state (without rows, if it has none) are an error.

    ``done`` is asked at the start and after each batch, not in between: its
    jobs (counts of what was written, say) take the stream's cores.
    """
    moved, seen, over = time.monotonic(), None, done()
    while query.isActive and not over:
        if time.monotonic() - moved > seconds:
            query.stop()
            raise TimeoutError(f"the stream was not done, and nothing came for {seconds:g} s")
        last = query.lastProgress
        if last is None or (last.batchId, last.timestamp) == seen:
            time.sleep(pause)
            continue
        seen, over = (last.batchId, last.timestamp), done()
        if any(s.numRowsUpdated or s.numRowsRemoved for s in last.stateOperators) or last.numInputRows and not last.stateOperators:
            moved = time.monotonic()
    failure = query.exception()
    query.stop()
    if failure is not None:
        raise failure


def to_files(rows: DataFrame, out: str, checkpoint: str, trigger: str = "0 seconds") -> StreamingQuery:
    """Parquet of exactly the rows of committed batches."""
    return rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(processingTime=trigger).start()


def once(stream: DataFrame, key: list[str], at: str, late: str = "1 hour") -> DataFrame:
    """Rows whose key has not come before, remembered for as long as rows may be late."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark(key)


def dropped_late(query: StreamingQuery, operator: str = "") -> int:
    """Rows that came after the watermark had passed them and so count nowhere (of the progress that Spark still holds).

    ``operator`` narrows it to state operators whose name holds the word.
    Aggregations count what is left after their partial sums; ``once`` ("dedupe")
    counts row by row.
    """
    return sum(s["numRowsDroppedByWatermark"] for p in query.recentProgress for s in p["stateOperators"] if operator in s["operatorName"])


def read_output(spark: SparkSession, out: str, schema: str) -> DataFrame:
    """What a stream has committed to ``out``; no rows before the first batch."""
    return spark.read.schema(schema).parquet(out) if Store(spark).exists(f"{out}/_spark_metadata") else spark.createDataFrame([], schema)
