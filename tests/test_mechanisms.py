"""Data source and its stream, schema compiler, stateful streams, positions, page ranges, paced calls, committed tables, merged formulas."""

import http.server
import json
import math
import random
import re
import threading
import time
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from itemloom import jobs
from itemloom.functions import contract, latex
from itemloom.operators import answers, calls, dominance, enrich, ordinal, ranges, retrieval
from itemloom.shared import Store
from itemloom.sources import converted, files, store
from itemloom.streaming import resume, stateful


# --- files behind a converter ---


def shouting():
    def shout(name, content):
        if content == b"hang":
            time.sleep(60)
        if content == b"die":
            import os

            os._exit(3)
        return [(i, 1, x.upper()) for i, x in enumerate(content.decode().splitlines())]

    return shout


def test_converted_files_in_batch(spark, tmp_path):
    for i, c in enumerate([b"a\nb", b"hang", b"\xff\xfe", b"die", b""]):
        (tmp_path / f"f{i}.txt").write_bytes(c)
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "g.txt").write_bytes(b"c")
    (tmp_path / "_hidden.txt").write_bytes(b"no")
    (tmp_path / "f.other").write_bytes(b"no")
    converted.register(spark, "shout", shouting())
    read = spark.read.format("shout").option("timeout", 1.5).option("glob", "*.txt")
    rows = read.load(str(tmp_path))
    got = sorted((r.path.rpartition("/")[2], r.text or "", bool(r.error)) for r in rows.collect())
    assert got == [("f0.txt", "A", False), ("f0.txt", "B", False), ("f1.txt", "", True), ("f2.txt", "", True), ("f3.txt", "", True), ("g.txt", "C", False)]
    why = {r.path[-6:]: r.error for r in converted.failures(rows).collect()}
    assert "no result after" in why["f1.txt"] and "Unicode" in why["f2.txt"] and "exit code 3" in why["f3.txt"]
    assert read.option("recursive", "false").load(str(tmp_path)).where("text = 'C'").count() == 0
    assert read.option("recursive", "true").load(str(tmp_path)).rdd.getNumPartitions() == 6
    assert read.option("partition_bytes", 1 << 20).load(str(tmp_path)).rdd.getNumPartitions() == 1
    assert read.load(str(tmp_path / "nowhere")).count() == 0


def test_programs_as_converters(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"one\n\ntwo")
    converted.register(spark, "by_cat", ["cat", "{file}"])
    converted.register(spark, "by_stdin", ["cat"])
    converted.register(spark, "no_such", ["no-such-program-here"])
    converted.register(spark, "sleeper", ["sleep", "30"])
    read = lambda name: [(r.pos, r.text, bool(r.error)) for r in spark.read.format(name).option("timeout", 1).load(str(tmp_path)).orderBy("pos").collect()]
    assert read("by_cat") == read("by_stdin") == [(0, "one", False), (2, "two", False)]
    assert read("no_such") == read("sleeper") == [(None, None, True)]


def test_converted_files_as_a_stream(spark, tmp_path):
    src, out, ck = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "ck")
    src.mkdir()
    converted.register(spark, "shout_stream", shouting())

    def run():
        q = spark.readStream.format("shout_stream").option("timeout", 2).load(str(src)).writeStream.format("parquet").option("path", out).option("checkpointLocation", ck).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return sorted(r.text for r in spark.read.parquet(out).where("error is null").collect())

    (src / "a.txt").write_bytes(b"x\ny")
    assert run() == ["X", "Y"]
    assert run() == ["X", "Y"]  # nothing new
    (src / "b.txt").write_bytes(b"z")
    (src / "c.txt").write_bytes(b"\xff")
    assert run() == ["X", "Y", "Z"]
    assert spark.read.parquet(out).where("error is not null").count() == 1


def test_stream_offsets_hold_late_files(tmp_path):
    import os

    reader = converted.StreamReader({"path": str(tmp_path), "lag": "100"}, shouting())
    put = lambda name, at: ((tmp_path / name).write_text("x"), os.utime(tmp_path / name, (at, at)))
    put("a", 1000)
    first = reader.latestOffset()
    put("late", 950)  # older than what was seen, within the lag
    put("b", 2000)
    second = reader.latestOffset()
    put("c", 2001)
    names = lambda s, e: [f.path.rpartition("/")[2] for p in reader.partitions(s, e) for f in p.files]
    assert names(reader.initialOffset(), first) == ["a"]
    assert names(first, second) == ["late", "b"] == names(json.loads(json.dumps(first)), second)
    assert names(second, second) == [] and names(second, reader.latestOffset()) == ["c"]


# --- JSON Schema ---

ITEM = {
    "type": "object", "required": ["id", "options"], "additionalProperties": False,
    "properties": {
        "id": {"type": "string", "pattern": "^q[0-9]+$", "maxLength": 4}, "n": {"type": "integer", "minimum": 1, "exclusiveMaximum": 90, "multipleOf": 1},
        "kind": {"enum": ["mcq", "integer", None, 7]}, "options": {"type": "array", "minItems": 1, "maxItems": 4, "uniqueItems": True, "items": {"$ref": "#/$defs/option"}},
        "meta": {"type": ["object", "null"], "maxProperties": 2, "properties": {"tags": {"prefixItems": [{"const": "first"}], "items": {"type": "string", "minLength": 2}}}, "additionalProperties": {"type": "number"}},
        "either": {"oneOf": [{"type": "integer"}, {"type": "number", "minimum": 5}]}, "never": {"not": {"type": "string"}},
    },
    "$defs": {"option": {"type": "object", "required": ["id"], "properties": {"id": {"enum": ["1", "2", "3", "4"]}, "text": {"anyOf": [{"type": "string"}, {"type": "null"}]}}}},
}


def kind_of(x):
    return "null" if x is None else "boolean" if isinstance(x, bool) else "integer" if isinstance(x, int) or isinstance(x, float) and x == int(x) else "number" if isinstance(x, float) else {str: "string", list: "array", dict: "object"}[type(x)]


def judged(node, x, path="$", root=ITEM):
    """Violations by walking the schema beside the value."""
    out, kind = [], kind_of(x)
    fits = lambda sub: not judged(sub, x, path)
    say = lambda wrong, rule, at=path: out.append((at, rule)) if wrong else None
    if "$ref" in node:
        out += judged(root["$defs"][node["$ref"].rpartition("/")[2]], x, path)
    if "type" in node:
        names = node["type"] if isinstance(node["type"], list) else [node["type"]]
        say(kind not in names and not (kind == "integer" and "number" in names), "type")
    if "enum" in node:
        say(not any(kind_of(e) == kind and e == x or kind in ("integer", "number") and isinstance(e, int) and not isinstance(e, bool) and e == x for e in node["enum"]), "enum")
    if "const" in node:
        say(node["const"] != x, "const")
    if kind in ("integer", "number"):
        for rule, bad in (("minimum", lambda b: x < b), ("exclusiveMaximum", lambda b: x >= b), ("multipleOf", lambda b: x / b != round(x / b))):
            say(rule in node and bad(node.get(rule, 1)), rule)
    if kind == "string":
        say("pattern" in node and not re.search(node.get("pattern", ""), x), "pattern")
        say(len(x) < node.get("minLength", 0), "minLength")
        say(len(x) > node.get("maxLength", 10**9), "maxLength")
    if kind == "array":
        say(len(x) < node.get("minItems", 0), "minItems")
        say(len(x) > node.get("maxItems", 10**9), "maxItems")
        say(node.get("uniqueItems") and len({json.dumps(i, sort_keys=True) for i in x}) < len(x), "uniqueItems")
        first = node.get("prefixItems", [])
        for i, v in enumerate(x):
            sub = first[i] if i < len(first) else node.get("items", {})
            out += judged(sub, v, f"{path}[{i}]")
    if kind == "object":
        say(len(x) > node.get("maxProperties", 10**9), "maxProperties")
        for n in node.get("required", []):
            say(n not in x, "required", f"{path}.{n}")
        for n, v in x.items():
            sub = node.get("properties", {}).get(n, node.get("additionalProperties", {}))
            if sub is False:
                say(True, "additionalProperties", f"{path}.{n}")
            else:
                out += judged(sub, v, f"{path}.{n}")
    for word in ("anyOf", "oneOf"):
        if word in node:
            n = sum(map(fits, node[word]))
            say(n == 0 if word == "anyOf" else n != 1, word)
    if "not" in node:
        say(fits(node["not"]), "not")
    return out


def random_items(n=300, seed=4):
    rng = random.Random(seed)
    scalar = lambda: rng.choice([None, True, 0, 1, 7, 2.5, 6.0, "", "1", "2", "q1", "q22222", "first", "ab", "a"])
    option = lambda: rng.choice([{"id": rng.choice(["1", "2", "5"]), "text": scalar()}, {"text": "x"}, {"id": "3"}, scalar()])
    out = [{"id": "q1", "options": [{"id": "1"}]}, [1], "s", None, {}]
    for _ in range(n):
        x = {k: f() for k, f in (("id", scalar), ("n", scalar), ("kind", scalar), ("options", lambda: rng.choice([scalar(), [option() for _ in range(rng.randint(0, 6))]])), ("meta", lambda: rng.choice([scalar(), {"tags": [scalar() for _ in range(3)], "w": scalar()}, {"a b": 1, "c": 2, "d": "x"}])), ("either", scalar), ("never", scalar), ("more", scalar)) if rng.random() < 0.7}
        out.append(x)
    return out


def test_schema_rules_agree_with_a_walk(spark):
    docs = random_items()
    df = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs)] + [(-1, "{nope"), (-2, None)], "i int, t string")
    got = {r.i: sorted((v.path, v.rule) for v in r.violations) for r in contract.validated(df, ITEM, "t").collect()}
    assert got.pop(-1) == got.pop(-2) == [("$", "json")]
    for i, d in enumerate(docs):
        assert got[i] == sorted(judged(ITEM, d)), d
    whole, report = contract.split(df, ITEM, "t")
    assert whole.count() == len(docs) + 2 and report.count() == 2 + sum(len(judged(ITEM, d)) for d in docs)
    assert contract.rule_counts(df, ITEM, "t").where("place = '$.options[*].id' and rule = 'enum'").first().n == sum(p.startswith("$.options[") and p.endswith(".id") and r == "enum" for d in docs for p, r in judged(ITEM, d))


def test_schema_of_typed_rows(spark):
    rows = spark.createDataFrame([(1, "a", [("x", 1)]), (None, "b", [(None, 0), ("z", 3)])], "n int, s string, l array<struct<k:string,v:int>>")
    schema = {"required": ["n"], "properties": {"s": {"enum": ["a"]}, "l": {"items": {"required": ["k"], "properties": {"v": {"minimum": 1}}}}}}
    got = {r.s: {tuple(v) for v in r.violations} for r in contract.validated(rows, schema).collect()}
    assert got == {"a": set(), "b": {("$.n", "required"), ("$.s", "enum"), ("$.l[0].k", "required"), ("$.l[0].v", "minimum")}}


@pytest.mark.parametrize("bad", [{"type": "text"}, {"$ref": "#/$defs/x"}, {"patternProperties": {}}, {"properties": {"a": 3}}, {"$ref": "other.json"}, {"$ref": "#/$defs/a", "$defs": {"a": {"items": {"$ref": "#/$defs/a"}}}}])
def test_bad_schemas_do_not_compile(spark, bad):
    with pytest.raises(contract.SchemaError):
        contract.compiled(bad)


# --- streams ---


def poisoned():
    class Poisoned(enrich.OfflineProvider):
        def complete(self, prompt):
            if "poison" in prompt:
                raise RuntimeError("no")
            return super().complete(prompt)

    return Poisoned()


def test_a_killed_stream_tags_each_item_once(spark, tmp_path):
    schema = "paper_id string, n long, question_text string"
    rows = [(f"p{i % 4}", i, "poison" if i % 17 == 3 else f"force {i}") for i in range(120)]
    src, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(src)
    made = lambda: stateful.read_output(spark, out, stateful.TAGGED)

    def run(n):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
        q = stateful.to_files(stateful.tagging(stream, poisoned(), ["n"], wait=0.4), out, ck)
        stateful.until(q, lambda: made().count() >= n, 150)

    run(30)  # stopped while items are open
    first = made().count()
    spark.createDataFrame([*rows[:20], ("p9", None, None)], schema).write.mode("append").parquet(src)  # items that come again
    run(121)
    got = {r.item: (r.tag_status, r.tries, r.subject) for r in made().collect()}
    assert first >= 30 and made().count() == 121 == len(got)
    for paper, i, text in rows:
        status, tries, subject = got[json.dumps({"n": i}, separators=(",", ":"))]
        assert (status, subject) == (("failed", "Unknown") if text == "poison" else ("ok", "Physics")) and (tries == 3 if text == "poison" else tries <= 2), paper


def test_open_items_are_asked_again_after_a_restart_without_new_rows(spark, tmp_path):
    schema = "paper_id string, n long, question_text string"
    src, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    spark.createDataFrame([("p", i, "poison" if i == 3 else "force") for i in range(10)], schema).coalesce(1).write.parquet(src)
    made = lambda: stateful.read_output(spark, out, stateful.TAGGED)
    rows = lambda: stateful.tagging(spark.readStream.schema(schema).parquet(src), poisoned(), ["n"], wait=0.2)
    assert rows().writeStream.format("parquet").option("path", out).option("checkpointLocation", ck).trigger(once=True).start().awaitTermination(60)
    assert made().count() == 0  # a whole batch, all of it open
    stateful.until(stateful.to_files(rows(), out, ck), lambda: made().count() >= 10, 40)
    assert sorted((r.tag_status, r.tries) for r in made().collect()) == [("failed", 3)] + [("ok", 2)] * 9


class Kept(dict):
    """A map state without a JVM; ``trips`` counts what would go there."""

    trips = 0

    def exists(self):
        Kept.trips += 1
        return bool(self)

    def containsKey(self, key):
        Kept.trips += 1
        return key in self

    def updateValue(self, key, value):
        Kept.trips += 1
        self[key] = value

    def iterator(self):
        Kept.trips += 1
        return iter(list(self.items()))

    def values(self):
        Kept.trips += 1
        return iter(list(super().values()))


class Handle:
    def __init__(self):
        self.states, self.timers = {}, []

    def getMapState(self, name, *_):
        return self.states.setdefault(name, Kept())

    def registerTimer(self, at):
        self.timers.append(at)

    def getCurrentProcessingTimeInMs(self):
        return 1000


def test_a_new_paper_asks_little_of_the_state():
    handle, row = Handle(), Row("paper_id", "item", "text")
    t = stateful.Tagging(poisoned())
    t.init(handle)

    def came(items, text="force"):
        Kept.trips = 0
        got = [r.item for r in t.handleInputRows(("p",), iter([row("p", f"i{i}", text) for i in items]), handle)]
        return got, Kept.trips

    assert came(range(100)) == ([f"i{i}" for i in range(100)], 13)  # three and one for each call; 300 item by item
    got, trips = came(range(50, 150))  # half of them again
    assert got == [f"i{i}" for i in range(100, 150)] and trips == 8
    assert came([7, 149])[0] == []
    assert came([200, 201], "poison")[0] == [] and handle.timers == [3000] and len(handle.states["open"]) == 2
    assert came([201, 202])[0] == ["i202"]  # open ones are not handed out again
    for tries in (2, 3):
        Kept.trips, failed = 0, [(r.item, r.tag_status, r.tries) for r in t.handleExpiredTimer(("p",), handle, None)]
        assert failed == ([] if tries == 2 else [("i200", "failed", 3), ("i201", "failed", 3)])
    assert came([200, 201, 202])[0] == []


def test_a_large_paper_is_not_read_again_as_a_whole():
    handle, row = Handle(), Row("paper_id", "item", "text")
    t = stateful.Tagging(poisoned())
    t.init(handle)
    came = lambda items: [r.item for r in t.handleInputRows(("p",), iter([row("p", f"i{i}", "force") for i in items]), handle)]
    for lo in range(0, 3000, 600):
        assert len(came(range(lo, lo + 600))) == 600
    assert sum(len(items) for (items,) in handle.states["early"].values()) == stateful.FEW == 3000 - len(handle.states["done"])
    assert came(range(3000)) == [] and came([2999, 3000]) == ["i3000"]


class Running:
    """A stream of so many batches that change its state, then of idle ones."""

    def __init__(self, batches, each=1):
        self.batches, self.each, self.looks, self.isActive = batches, each, 0, True

    @property
    def lastProgress(self):
        n = self.looks // self.each
        self.looks += 1
        return SimpleNamespace(batchId=n, timestamp=str(n), numInputRows=1, stateOperators=[SimpleNamespace(numRowsUpdated=int(n < self.batches), numRowsRemoved=0)])

    def exception(self):
        return None

    def stop(self):
        self.isActive = False


def test_a_stream_may_run_for_long_while_rows_come():
    q, asked = Running(12, each=5), []
    stateful.until(q, lambda: asked.append(1) or len(asked) > 10, 0.2, 0.01)  # 0.5 s
    assert not q.isActive and len(asked) == 11 and q.looks > 40  # once a batch
    q = Running(3, each=5)
    with pytest.raises(TimeoutError):
        stateful.until(q, lambda: False, 0.2, 0.01)
    assert not q.isActive


def test_late_rows_are_counted(spark, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    schema = "ts timestamp, event_type string, value double"
    batches = [["10:00:00", "10:20:00"], ["11:30:00"], ["10:30:00", "11:25:00"], ["13:00:00"]]  # 10:30 is behind the watermark of 11:20, its window closed; 11:25 is not
    totals = []
    for i, times in enumerate(batches):
        spark.createDataFrame([(f"2024-01-01 {x}", "a", 1.0) for x in times], "t string, event_type string, value double").select(F.col("t").cast("timestamp").alias("ts"), "event_type", "value").coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(schema).parquet(src)
        q = resume.windowed(stream, "1 hour", "10 minutes").writeStream.format("parquet").option("path", out).option("checkpointLocation", ck).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination(120)
        totals.append(stateful.dropped_late(q))
        assert i < 4
    got = {(str(r.start)[11:16], r.n) for r in spark.read.parquet(out).collect()}
    assert got == {("10:00", 2), ("11:00", 2)} and sum(totals) == 1


def test_sessions_and_once_on_a_stream(spark, tmp_path):
    src = str(tmp_path / "in")
    rows = [(1, "2024-01-01 10:00:00", 5), (1, "2024-01-01 10:10:00", 6), (1, "2024-01-01 12:00:00", 7), (2, "2024-01-01 10:05:00", 8), (2, "2024-01-01 10:05:00", 8)]
    spark.createDataFrame(rows, "user_id long, t string, event_id long").select("user_id", F.col("t").cast("timestamp").alias("ts"), "event_id").write.parquet(src)
    stream = spark.readStream.schema("user_id long, ts timestamp, event_id long").parquet(src)
    for name, df, mode in (("s", resume.sessions(stream.withWatermark("ts", "10 minutes")), "complete"), ("o", stateful.once(stream, ["event_id"], "ts"), "append")):
        df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start().awaitTermination(120)
    assert sorted((r.user_id, r.n) for r in spark.table("s").collect()) == [(1, 1), (1, 2), (2, 2)]
    assert spark.table("o").count() == 4


# --- positions ---


def test_rows_without_a_key_are_zipped(spark):
    left = spark.range(1000).repartition(5).orderBy(F.desc("id"))
    right = spark.range(700).select(F.col("id"), (F.col("id") * 2).alias("v")).repartition(3).orderBy("id")
    got = sorted(map(tuple, ordinal.zip_rows(left, right).collect()))
    assert got == [(i, 999 - i, i, 2 * i) for i in range(700)]
    assert sorted(r.nth for r in ordinal.numbered(spark.range(50).repartition(7)).collect()) == list(range(50))
    assert ordinal.zip_rows(left, right.limit(0)).count() == 0 and ordinal.numbered(spark.range(0)).count() == 0


def test_lines_are_numbered_over_splits(spark, tmp_path):
    rng = random.Random(2)
    want = set()
    for name in ("a", "b"):
        lines = ["x" * rng.choice([0, 0, 3, 40]) + str(i) * (i % 3 > 0) for i in range(400)]
        (tmp_path / f"{name}.txt").write_bytes("".join(x + ("\r\n" if i % 5 == 0 else "\n") for i, x in enumerate(lines[:-1])).encode() + b"last")
        want |= {(name, i, x) for i, x in enumerate([*lines[:-1], "last"])}
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        assert spark.read.option("lineSep", "\n").text(str(tmp_path)).rdd.getNumPartitions() > 8
        got = {(r.path[-5], r.line, r.value) for r in ordinal.numbered_lines(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == want


# --- page ranges ---


def test_points_meet_ranges_once(spark):
    rng = random.Random(7)
    spans = [(i, rng.choice("pq"), a, a + rng.choice([-3, 0, 0, 1, 2, 9, 100, 1_000_000])) for i, a in enumerate(rng.randint(0, 300) for _ in range(80))]
    spans += [(900, "p", None, 3), (901, "p", 3, None), (902, "q", -5, 4), (903, "p", 0, (1 << 60))]
    dots = [(i, rng.choice("pqr"), rng.randint(0, 2000)) for i in range(150)] + [(800, "p", None), (801, "q", 0), (802, "p", -2)]
    got = ranges.points_in_ranges(spark.createDataFrame(dots, "d int, k string, page int"), spark.createDataFrame(spans, "s int, k string, lo long, hi long"), "page", "lo", "hi", ["k"])
    want = sorted((d, s) for d, k, p in dots for s, kk, lo, hi in spans if k == kk and None not in (p, lo, hi) and max(lo, 0) <= p <= hi and p >= 0)
    assert sorted((r.d, r.s) for r in got.collect()) == want
    n = spark.range(1).select(F.size(ranges.blocks_of(F.lit(1), F.lit(1_000_000))).alias("n")).first().n
    assert n <= 40


def test_page_values_of_long_ranges(spark):
    items = spark.createDataFrame([("p", 1, 1, 1_000_000), ("p", 2, 0, 2), ("p", 3, 5, 4), ("p", 4, None, None)], "paper_id string, seg int, page_start int, page_end int")
    pages = spark.createDataFrame([("p", 0, "zero"), ("p", 2, "b"), ("p", 2, "a"), ("p", 999_999, "z"), ("q", 2, "other")], "paper_id string, page int, f string")
    got = {r.seg: r.out for r in answers.with_page_values(items, pages, "f", "out").collect()}
    assert got == {1: ["a", "b", "z"], 2: ["a", "b"], 3: [], 4: []}


# --- paced calls ---


def test_a_bucket_keeps_its_rate():
    now, waited = [0.0], []

    def sleep(s):
        waited.append(s)
        now[0] += s

    bucket = calls.Bucket(4.0, lambda: now[0], sleep)
    for _ in range(9):
        bucket.take()
    assert now[0] == 2.0 and len(waited) == 8
    now[0] = 100.0
    bucket.take()
    bucket.back_off(3)
    bucket.take()
    assert now[0] == 103.0


class Counting(http.server.BaseHTTPRequestHandler):
    seen: list = []
    lock = threading.Lock()

    def do_POST(self):
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        prompt = body["messages"][0]["content"]
        with self.lock:
            self.seen.append((time.monotonic(), prompt))
            times = sum(p == prompt for _, p in self.seen)
        code = 400 if "refuse" in prompt else 429 if "busy" in prompt and times < 3 else 503 if "down" in prompt else 200
        out = json.dumps({"choices": [{"message": {"content": f"{body['model']}:{prompt}:{self.headers['Authorization']}"}}]}).encode() if code == 200 else b""
        self.send_response(code)
        if code == 429:
            self.send_header("Retry-After", "0.1")
        self.send_header("Content-Length", str(len(out)))
        self.end_headers()
        self.wfile.write(out)

    def log_message(self, *_):
        pass


def test_a_service_gets_no_more_than_its_rate(spark):
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Counting)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        provider = calls.ChatProvider(f"http://127.0.0.1:{server.server_port}/v1", "m1", "NO_KEY_IS_SET")
        prompts = [f"p{i}" for i in range(24)] + ["busy", "refuse", "down"]
        df = spark.createDataFrame([(p,) for p in prompts], "prompt string").repartition(6)
        limits = calls.Limits(rate=12, callers=2, in_flight=4, attempts=3, pause=0.05)
        got = {r.prompt: r for r in calls.Paced(provider, limits).completed(df).collect()}
    finally:
        server.shutdown()
    assert all(got[p].response == f"m1:{p}:Bearer " and got[p].tries == 1 for p in prompts[:24])
    assert got["busy"].response and got["busy"].tries == 3
    assert got["refuse"].response is None and got["refuse"].tries == 1 and "400" in got["refuse"].call_error
    assert got["down"].response is None and got["down"].tries == 3 and "503" in got["down"].call_error
    assert len(Counting.seen) == 24 + 3 + 1 + 3
    at = sorted(t for t, _ in Counting.seen)
    for i, t in enumerate(at):  # in any second no more than the rate and the two callers that begin, with slack for the clock
        assert sum(t <= x < t + 1 for x in at[i:]) <= 12 + 2 + 2


def test_operators_take_paced_providers(spark):
    items = spark.createDataFrame([("p", i, f"force {i}", ["a"]) for i in range(25)], "paper_id string, n int, question_text string, options array<string>")
    paced = calls.Paced(enrich.OfflineProvider(), calls.Limits(rate=100, callers=2))
    assert enrich.tagged(items, paced, ["paper_id", "n"]).where("subject = 'Physics' and tag_status = 'ok'").count() == 25


# --- committed tables ---


def test_half_written_tables_are_made_again(spark, tmp_path):
    path, made = str(tmp_path / "t"), []

    def make():
        made.append(1)
        return spark.range(100).repartition(3)

    assert store.kept(spark, path, make)[1] is False and store.kept(spark, path, make)[1] is True and len(made) == 1
    assert store.intact(spark, path)
    found = store.manifest_of(spark, path)
    assert found.rows == 100 and len(found.files) == 3
    (tmp_path / "t" / found.folder / next(iter(found.files))).unlink()  # a file is lost
    assert store.table(spark, path) is None and not store.intact(spark, path)
    assert store.kept(spark, path, make)[0].count() == 100 and len(made) == 2
    extra = tmp_path / "t" / store.manifest_of(spark, path).folder / "part-extra.parquet"
    extra.write_bytes(b"PAR1")  # a file that no commit wrote
    assert store.table(spark, path) is None
    spark.range(5).write.parquet(str(tmp_path / "half"))  # rows, but no manifest
    assert store.table(spark, str(tmp_path / "half")) is None and store.table(spark, str(tmp_path / "nowhere")) is None
    (tmp_path / "half" / store.MANIFEST).write_text("{torn")
    assert store.table(spark, str(tmp_path / "half")) is None
    store.commit(spark.range(7), path)
    assert store.table(spark, path).count() == 7 and len(list((tmp_path / "t").glob("data-*"))) == 1
    assert not store.intact(spark, str(tmp_path / "half"))


def test_digests_do_not_depend_on_order(spark, tmp_path):
    rows = spark.range(50).select("id", (F.col("id") % 3).cast("string").alias("s"))
    a, b = store.commit(rows.repartition(2), str(tmp_path / "a")), store.commit(rows.orderBy(F.desc("id")), str(tmp_path / "b"))
    c = store.commit(rows.where("id <> 7"), str(tmp_path / "c"))
    assert a.digest == b.digest != c.digest
    assert store.commit(spark.createDataFrame([], "m map<string,int>"), str(tmp_path / "d")).rows == 0 and store.table(spark, str(tmp_path / "d")).count() == 0


def test_cut_off_stages_run_again(spark, tmp_path):
    root, ran = str(tmp_path / "s"), []

    def stage(name):
        return name, lambda d: (ran.append(name), d.withColumn(name, F.lit(1)))[1]

    stages = [stage("one"), stage("two")]
    jobs.run_stages(spark.range(4), stages, root)
    found = store.manifest_of(spark, f"{root}/1-two")
    (tmp_path / "s" / "1-two" / found.folder / next(iter(found.files))).unlink()
    out, report = jobs.run_stages(spark.range(4), stages, root)
    assert [r["status"] for r in report] == ["kept", "success"] and ran == ["one", "two", "two"] and out.count() == 4


def test_folders_are_direct_children_with_their_paths(spark, tmp_path):
    for d in ("paper_1", "paper_2/deep", "old/paper_3", "other", "paper_4/paper_5"):
        (tmp_path / d).mkdir(parents=True)
    for f in ("paper_1/x.json", "paper_2/deep/x.json", "old/paper_3/x.json", "other/x.json", "paper_4/paper_5/x.json", "x.json"):
        (tmp_path / f).write_text("{}")
    got = files.paper_folders(spark, str(tmp_path), "paper_", "*.json").collect()
    assert [(r.folder, r.path.rpartition(":")[2]) for r in got] == [("paper_1", str(tmp_path / "paper_1"))]
    seen = []
    assert [r["status"] for r in jobs.post_process(spark, str(tmp_path), "paper_", "*.json", seen.append)] == ["success"]
    assert len(seen) == 1 and Store(spark).exists(seen[0])


# --- merged formulas ---


def fixpoint(text):
    while (new := re.sub(r"\$([^$]+)\$\s*\$([^$]+)\$", r"$\1 \2$", text)) != text:
        text = new
    return text


def test_any_number_of_formulas_merge(spark):
    rng = random.Random(1)
    texts = ["", "$a$", "$a$ $b$", "$a$$b$", "$$a$$ $b$", "x $a$ y $b$", "$a$\n\t$b$ c $d$ $e$", "$", "$$", "$$$", "$a$ $", "a$ $b$ $c", " ".join(f"${i}$" for i in range(10_000))]
    texts += ["".join(rng.choice(["$x$ ", "$y$", " w ", "\n", "$z + 1$ ", "v", "5$ "]) for _ in range(rng.randint(1, 25))) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = dict(df.select("i", latex.merge_formulas("t")).collect())
    for i, t in enumerate(texts):
        assert got[i] == fixpoint(t), t


# --- boxes that meet ---


def test_merge_counting_agrees_with_pairs():
    rng = np.random.default_rng(3)
    for n, m, top in ((0, 5, 3), (1, 4, 2), (37, 50, 9), (400, 300, 1000)):
        x, y, w = rng.integers(0, top, n).astype(float), rng.integers(0, top, n).astype(float), rng.integers(1, 5, n)
        qx, qy = rng.integers(-1, top + 2, m).astype(float), rng.integers(-1, top + 2, m).astype(float)
        want = [int(w[(x < a) & (y < b)].sum()) for a, b in zip(qx, qy, strict=True)]
        assert dominance.merge_counts(x, y, w, qx, qy).tolist() == want


@pytest.mark.parametrize(("least", "strips"), [(4_096, 1_024), (20, 9)])
def test_dense_and_hot_boxes_are_counted_without_pairs(spark, monkeypatch, least, strips):
    monkeypatch.setattr(dominance, "LEAST", least)
    monkeypatch.setattr(dominance, "STRIPS", strips)
    rng = np.random.default_rng(5)
    low = np.concatenate([rng.integers(0, 12, (200, 2)), rng.normal(5, 3, (100, 2)), np.column_stack([np.zeros(120), rng.normal(0, 4, 120)]), np.tile([[3.0, 3.0]], (80, 1))])
    high = low + np.concatenate([rng.integers(0, 4, (200, 2)), rng.exponential(1, (100, 2)), rng.exponential(2, (120, 2)), np.ones((80, 2))])
    boxes = [(i, float(a[0]), float(a[1]), float(b[0]), float(b[1])) for i, (a, b) in enumerate(zip(low, high, strict=True))]
    boxes += [(1000, None, 0.0, 1.0, 1.0), (1001, 5.0, 0.0, 4.0, 1.0), (1002, float("nan"), 0.0, 1.0, 1.0), (1003, 0.0, 0.0, float("nan"), 1.0), (None, 3.0, 3.0, 4.0, 4.0)]
    df = spark.createDataFrame(boxes, "id long, x0 double, y0 double, x1 double, y1 double").select("id", F.struct("x0", "x1", "y0", "y1").alias("box")).repartition(3)
    good = lambda b: None not in b[1:] and b[1] <= b[3] and b[2] <= b[4]
    meet = lambda a, b: a is not b and good(a) and good(b) and not (a[3] < b[1] or b[3] < a[1] or a[4] < b[2] or b[4] < a[2])
    want = sorted(((b[0], sum(meet(a, b) for a in boxes)) for b in boxes), key=str)
    assert sorted(map(tuple, retrieval.overlap_counts(df).collect()), key=str) == want
    assert retrieval.overlap_counts(df.limit(0)).count() == 0


# --- pruned search ---


def test_shards_that_cannot_hold_a_neighbour_are_left_out(spark):
    rng = np.random.default_rng(8)
    centres = rng.normal(0, 10, (25, 6))
    x = centres[rng.integers(0, 25, 2500)] + rng.normal(0, 0.3, (2500, 6))
    x[2400:2440] = x[7]  # ties
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(5000, [1.0, 2.0]), (5001, [1.0, 3.0]), (5002, None), (5003, [float("nan")] * 6)]
    store_df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    asked = [(i, x[i * 31].tolist()) for i in range(60)] + [(100, (centres[3] + 40).tolist()), (101, [0.0, 0.0]), (102, None), (103, [0.0] * 3)]
    queries = spark.createDataFrame(asked, "query_id long, query array<double>")
    report = {}
    got = {(r.query_id, r.rank): (r.vec_id, round(r.d2, 9)) for r in retrieval.nearest_batch(store_df, queries, 5, most_queries=20, most_rows=40, report=report).collect()}
    want = {}
    for q, v in asked:
        near = sorted((sum((a - b) ** 2 for a, b in zip(v, y, strict=True)), i) for i, y in rows if v and y and len(y) == len(v) and not math.isnan(y[0]))[:5]
        want |= {(q, n + 1): (i, round(d, 9)) for n, (d, i) in enumerate(near)}
    assert got == want
    assert report["made"] < 0.25 * report["possible"] and report["shards"] > 50


def test_items_are_made_once_for_all_values_of_their_pages(spark):
    made = spark.sparkContext.accumulator(0)

    def seen(x):
        made.add(1)
        return x

    rows = [(f"p{i % 3}", i, i % 7, i % 7 + (0, 1, 5)[i % 3]) for i in range(60)]
    items = spark.createDataFrame(rows, "paper_id string, seg long, page_start int, page_end int").withColumn("question_text", F.udf(seen, "string")(F.col("seg").cast("string")))
    pages = [(f"p{i % 3}", i % 11, f"f{i}") for i in range(40)]
    images = spark.createDataFrame(pages, "paper_id string, page int, filename string")
    mols = images.select("paper_id", "page", F.when(F.col("page") % 2 == 0, "success").otherwise("error").alias("status"), F.array("filename", F.lit("x")).alias("smiles"))
    got = {r.seg: r for r in answers.combined(items, images, mols).collect()}
    assert made.value == len(rows) == len(got)
    for paper, seg, lo, hi in rows:
        on = sorted((page, f) for p, page, f in pages if p == paper and page > 0 and lo <= page <= hi)
        assert got[seg].question_images == [f for _, f in on]
        assert got[seg].chemical_smiles == [s for _, s in sorted((page, s) for page, f in on if page % 2 == 0 for s in (f, "x"))]


def test_items_are_made_once_for_one_value_of_their_pages(spark):
    made = spark.sparkContext.accumulator(0)

    def seen(x):
        made.add(1)
        return x

    items = spark.createDataFrame([("p", i, i, i + i % 2) for i in range(20)], "paper_id string, seg int, page_start int, page_end int").withColumn("t", F.udf(seen, "string")("paper_id"))
    pages = spark.createDataFrame([("p", i, f"f{i:02}") for i in range(25)], "paper_id string, page int, f string")
    got = {r.seg: r.out for r in answers.with_page_values(items, pages, "f", "out").collect()}
    assert made.value == 20 and got == {i: [f"f{p:02}" for p in range(max(i, 1), i + i % 2 + 1)] for i in range(20)}
