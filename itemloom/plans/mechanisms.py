"""Queries of the data source, the schema compiler, stateful streams, positions, page ranges, paced calls, committed tables and sketches."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import contract, latex
from ..operators import calls, enrich, ordinal, ranges, sketches
from ..sources import converted, files, sinks, store
from ..streaming import resume, stateful
from .own import fresh
from .registry import Tables, query

SPACES = "select doc_id, (length(coalesce(text, '')) - length(replace(coalesce(text, ''), ' ', '')))::bigint as spaces, md5(coalesce(text, '')) as h, 0::bigint as errors from documents"


def json_lines():
    """A converter: each line of a file is a span, its document's id the page."""

    def convert(name: str, content: bytes) -> list[tuple[int, int, str]]:  # noqa: ARG001
        rows = [json.loads(x) for x in content.decode().splitlines()]
        return [(i, r["doc_id"], r.get("text") or "") for i, r in enumerate(rows)]

    return convert


def documents_as_files(docs: DataFrame, path: str) -> None:
    """Files of at most 2,000 documents."""
    docs.select("doc_id", "text").write.option("maxRecordsPerFile", 2_000).mode("append").json(path)


def spaces_of(spans: DataFrame) -> DataFrame:
    text = F.col("text")
    n = F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))
    return spans.select(F.col("page").cast("long").alias("doc_id"), n.cast("long").alias("spaces"), F.md5(text).alias("h"), F.col("error").isNotNull().cast("long").alias("errors"))


@query(SPACES)
def q_converted_source(t: Tables) -> DataFrame:
    """Every document, from files read through a registered format."""
    path = fresh(t, "source")
    documents_as_files(t.documents, path)
    converted.register(t.spark, "json_line_files", json_lines())
    return spaces_of(t.spark.read.format("json_line_files").option("timeout", 300).load(path))


@query(SPACES)
def q_converted_stream(t: Tables) -> DataFrame:
    """The same files as a stream that stops and goes on: what came before is not read again."""
    path, out, checkpoint = fresh(t, "drop"), fresh(t, "spans"), fresh(t, "offsets")
    converted.register(t.spark, "json_line_files", json_lines())
    for part in (0, 1):
        documents_as_files(t.documents.where(F.pmod("doc_id", F.lit(2)) == part), path)
        rows = t.spark.readStream.format("json_line_files").option("timeout", 300).load(path)
        rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spaces_of(stateful.read_output(t.spark, out, converted.SCHEMA))


#: The contract of a document's nested form below.
CONTRACT = {
    "type": "object", "required": ["id", "parts"], "additionalProperties": False,
    "properties": {
        "id": {"type": "string", "pattern": "^d[0-9]+$"}, "n": {"type": "integer", "minimum": 200, "maximum": 3000}, "lang": {"enum": ["en", "de", "fr"]}, "label": {"type": ["number", "null"]},
        "parts": {"type": "array", "minItems": 2, "items": {"$ref": "#/$defs/part"}},
    },
    "$defs": {"part": {"type": "object", "required": ["kind"], "properties": {"kind": {"enum": ["head", "tail"]}, "text": {"type": "string", "minLength": 12, "pattern": "[a-z]"}}}},
}


@query("""
with d as (
  select doc_id, lang, n_chars, coalesce(text, '') as text, case when doc_id % 5 <> 0 then 'd' || doc_id else doc_id::varchar end as id, doc_id % 3 as n_parts from documents),
p as (
  select doc_id, i, case i when 0 then 'head' when 1 then 'tail' else 'more' end as kind, case i when 0 then left(text, 20) when 1 then right(text, 11) else text end as part
  from d, (select unnest(range(3)) as i) where i < n_parts + 1),
v as (
  select doc_id, '$.id' as path, 'pattern' as rule from d where not regexp_matches(id, '^d[0-9]+$')
  union all select doc_id, '$.n', 'minimum' from d where n_chars < 200
  union all select doc_id, '$.n', 'maximum' from d where n_chars > 3000
  union all select doc_id, '$.lang', 'enum' from d where lang not in ('en', 'de', 'fr')
  union all select doc_id, '$.label', 'type' from d where doc_id % 7 = 0
  union all select doc_id, '$.source', 'additionalProperties' from d where doc_id % 4 = 0
  union all select doc_id, '$.parts', 'minItems' from d where n_parts + 1 < 2
  union all select doc_id, '$.parts[' || i || '].kind', 'enum' from p where kind not in ('head', 'tail')
  union all select doc_id, '$.parts[' || i || '].text', 'minLength' from p where length(part) < 12
  union all select doc_id, '$.parts[' || i || '].text', 'pattern' from p where not regexp_matches(part, '[a-z]'))
select * from v
""")
def q_schema_violations(t: Tables) -> DataFrame:
    """V5, V6: every document as a nested JSON text against a schema: one row for each broken rule, with its path."""
    text = F.coalesce("text", F.lit(""))
    k = F.col("doc_id")
    part = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.alias("text"))
    parts = F.slice(F.array(part("head", F.left(text, F.lit(20))), part("tail", F.right(text, F.lit(11))), part("more", text)), 1, (k % 3 + 1).cast("int"))
    doc = F.struct(
        F.when(k % 5 != 0, F.concat(F.lit("d"), k.cast("string"))).otherwise(k.cast("string")).alias("id"), F.col("n_chars").alias("n"), "lang",
        F.when(k % 7 == 0, F.lit("none")).alias("label"), F.when(k % 4 == 0, F.lit("x")).alias("source"), parts.alias("parts"),
    )
    _, report = contract.split(t.documents.select("doc_id", F.to_json(doc).alias("j")), CONTRACT, "j")
    return report.select("doc_id", "path", "rule")


class Touchy(enrich.OfflineProvider):
    """Fails for every batch that holds a text whose length 97 divides."""

    def complete(self, prompt: str) -> str:
        if any(len(r["text"]) % 97 == 0 for r in json.loads(prompt.partition("\n")[2])):
            raise RuntimeError("no answer")
        return super().complete(prompt)


#: What the offline provider says of a text.
SUBJECT = "case when contains(lower(text), 'bond') or contains(lower(text), 'acid') then 'Chemistry' when contains(lower(text), 'force') or contains(lower(text), 'energy') then 'Physics' else 'Mathematics' end"


@query(f"""
with d as (select doc_id, coalesce(text, '') as text from documents)
select doc_id, case when length(text) % 97 = 0 then 'failed' else 'ok' end as status, case when length(text) % 97 = 0 then 'Unknown' else {SUBJECT} end as subject,
       case when length(text) % 97 = 0 then 3 else case when bool_or(length(text) % 97 = 0) over (partition by doc_id // 10) then 2 else 1 end end as tries, 1::bigint as times
from d
""")
def q_reopened_batches(t: Tables) -> DataFrame:
    """A stream of all documents, ten a batch; failed batches are reopened by timer and asked item by item, across a restart."""
    path, out, checkpoint = fresh(t, "items"), fresh(t, "tags"), fresh(t, "state")
    paper = F.expr("cast(doc_id div 10 as string)")
    # a paper's items stand in one file, so they come in one batch
    t.documents.select(paper.alias("paper_id"), "doc_id", F.col("text").alias("question_text")).repartition("paper_id").write.parquet(path)
    n, done = t.documents.count(), lambda: stateful.read_output(t.spark, out, stateful.TAGGED).count()
    for goal in (n // 3, n):
        stream = t.spark.readStream.schema("paper_id string, doc_id long, question_text string").option("maxFilesPerTrigger", 8).parquet(path)
        rows = stateful.tagging(stream, Touchy(), ["doc_id"], wait=0.2)
        stateful.until(stateful.to_files(rows, out, checkpoint), lambda goal=goal: done() >= goal, 600, 1.0)
    rows = stateful.read_output(t.spark, out, stateful.TAGGED)
    doc = F.get_json_object("item", "$.doc_id").cast("long").alias("doc_id")
    return rows.groupBy(doc, F.col("tag_status").alias("status"), "subject", "tries").agg(F.count("*").alias("times"))


@query("""
with e as (select *, event_id % 10 = 0 as second from events),
mark as (select date_trunc('milliseconds', max(ts)) - interval 10 minutes as at from e where not second),
taken as (select e.* from e, mark where not second or ts > mark.at),
last as (select date_trunc('milliseconds', max(ts)) - interval 10 minutes as at from taken)
select date_trunc('hour', ts) as start, event_type, count(*) as n, round(sum(value), 4) as total, (select count(*) + count(*) filter (event_id % 3 = 0) from e, mark where second and ts <= mark.at) as late
from taken, last where date_trunc('hour', ts) + interval 1 hour <= last.at group by 1, 2
""")
def q_late_rows(t: Tables) -> DataFrame:
    """Windows of a stream that runs: every tenth event comes after the watermark has passed nearly all of them; each repeated event counts once, and the late ones are counted apart."""
    path, out, checkpoint = fresh(t, "events"), fresh(t, "windows"), fresh(t, "marks")
    rows, late = t.events.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", "value"), 0
    for second in (False, True):
        some = rows.where((F.col("event_id") % 10 == 0) == second)
        some.union(some.where("event_id % 3 = 0")).write.mode("append").parquet(path)
        stream = stateful.once(t.spark.readStream.schema("event_id long, ts timestamp, event_type string, value double").parquet(path), ["event_id"], "ts", "10 minutes")
        run = resume.windowed_on(stream, "ts", "1 hour").writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        run.awaitTermination()
        late += stateful.dropped_late(run, "dedupe")
    found = stateful.read_output(t.spark, out, "start timestamp, event_type string, n long, total double")
    return found.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"), F.lit(late).cast("long").alias("late"))


@query("""
select nth, d.doc_id, l.doc_id as label_id, l.toxic
from (select doc_id, row_number() over (order by doc_id) - 1 as nth from documents) d
join (select doc_id, toxic, row_number() over (order by doc_id desc) - 1 as nth from labels) l using (nth)
""")
def q_zip_rows(t: Tables) -> DataFrame:
    """Documents in order beside labels in falling order, without a key; the shorter side decides."""
    right = t.labels.select(F.col("doc_id").alias("label_id"), "toxic").orderBy(F.desc("label_id"))
    return ordinal.zip_rows(t.documents.select("doc_id").orderBy("doc_id"), right)


@query("select doc_id % 16 as bucket, row_number() over (partition by doc_id % 16 order by doc_id) - 1 as _idx, doc_id, length(text)::bigint as n from documents")
def q_jsonl_lines(t: Tables) -> DataFrame:
    """Every document as a line of one of sixteen large files, read in splits, with its physical line."""
    path = fresh(t, "lines")
    rows = t.documents.select("doc_id", "text", (F.col("doc_id") % 16).alias("bucket"))
    rows.repartition("bucket").sortWithinPartitions("bucket", "doc_id").write.partitionBy("bucket").json(path)
    lines = files.jsonl_with_ordinal(t.spark, f"{path}/*", "doc_id long, text string")
    return lines.select(F.regexp_extract("_path", "bucket=([0-9]+)", 1).cast("long").alias("bucket"), "_idx", "doc_id", F.length("text").cast("long").alias("n"))


@query("""
with spans as (select doc_id, source, n_chars as lo, n_chars + case doc_id % 3 when 0 then -1 when 1 then 0 else 40 end as hi from documents),
dots as (select doc_id, source, n_chars as page from documents where doc_id % 50 = 0)
select s.doc_id, count(*) as n, sum(d.doc_id)::bigint as ids from spans s join dots d on d.source = s.source and d.page between s.lo and s.hi group by 1
""")
def q_page_ranges(t: Tables) -> DataFrame:
    """Ranges of lengths against the lengths of every fiftieth document, by dyadic blocks."""
    k = F.col("doc_id") % 3
    spans = t.documents.select(F.col("doc_id").alias("span"), "source", F.col("n_chars").alias("lo"), (F.col("n_chars") + F.when(k == 0, -1).when(k == 1, 0).otherwise(40)).alias("hi"))
    dots = t.documents.where("doc_id % 50 = 0").select("doc_id", "source", F.col("n_chars").alias("page"))
    met = ranges.points_in_ranges(dots, spans, "page", "lo", "hi", ["source"])
    return met.groupBy(F.col("span").alias("doc_id")).agg(F.count("*").alias("n"), F.sum("doc_id").alias("ids"))


@query(r"""
with w as (select doc_id, regexp_extract_all(text, '[A-Za-z0-9]+') as words from documents)
select doc_id, len(words)::bigint as n, case len(words) when 0 then md5('') else md5('$' || array_to_string(words, ' ') || '$') end as h from w where words is not null
""")
def q_merged_formulas(t: Tables) -> DataFrame:
    """Every word of a text as a formula of its own; all of a text's formulas become one."""
    words = F.regexp_extract_all("text", F.lit("[A-Za-z0-9]+"), F.lit(0))
    apart = F.array_join(F.transform(words, lambda w: F.concat(F.lit("$"), w, F.lit("$"))), " \n")
    rows = t.documents.where("text is not null").select("doc_id", F.size(words).cast("long").alias("n"), apart.alias("t"))
    return rows.select("doc_id", "n", F.md5(latex.merge_formulas("t")).alias("h"))


@query("""
select doc_id, length(coalesce(text, ''))::bigint as n, (select count(*) from documents) as committed, true as intact, true as remade, true as kept from documents
""")
def q_committed_table(t: Tables) -> DataFrame:
    """A committed table is read as its manifest says; rows without a manifest are no table and are made again."""
    path = fresh(t, "committed")
    rows = t.documents.select("doc_id", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n"))
    rows.limit(1).write.parquet(f"{path}/data-cut-off")  # what a killed job leaves
    _, there = store.kept(t.spark, path, lambda: rows)
    again, kept = store.kept(t.spark, path, lambda: rows.limit(0))
    found = store.manifest_of(t.spark, path)
    return again.select("*", F.lit(found.rows).cast("long").alias("committed"), F.lit(store.intact(t.spark, path)).alias("intact"), F.lit(not there).alias("remade"), F.lit(kept).alias("kept"))


@query(f"""
with d as (select doc_id, doc_id // 10 as paper, left(coalesce(text, ''), 500) as text from documents),
b as (select *, bool_or(length(text) % 97 = 0) over (partition by paper) as bad from d)
select doc_id, case when bad then 'Unknown' else {SUBJECT} end as subject, case when bad then 'failed' else 'ok' end as tag_status from b
""")
def q_paced_calls(t: Tables) -> DataFrame:
    """Tagging through a provider with a rate, retries and calls in flight; a batch that stays without an answer has the defaults (prompts hold 500 characters of an item, N27)."""
    items = t.documents.select(F.expr("cast(doc_id div 10 as string)").alias("paper_id"), "doc_id", F.coalesce("text", F.lit("")).alias("question_text"), F.lit(None).cast("array<string>").alias("options"))
    paced = calls.Paced(Touchy(), calls.Limits(rate=100_000, callers=4, in_flight=8, attempts=2, pause=0.001))
    return enrich.tagged(items, paced, ["doc_id"]).select("doc_id", "subject", "tag_status")


@query("""
with d as (select (doc_id // 1000)::bigint as part, text from documents where text is not null)
select part, count(*) as n, count(distinct md5(text)) as texts, (select count(distinct md5(text)) from d) as all_texts, true as texts_within, true as ranks_within from d group by part
""")
def q_stored_sketches(t: Tables) -> DataFrame:
    """Sketches of batches of a hundred documents, stored, then merged by the thousand and in all: distinct texts and quantiles of lengths within the stated error of the exact ones."""
    rows = t.documents.where("text is not null").select("doc_id", F.expr("doc_id div 100").alias("batch"), F.expr("doc_id div 1000").alias("part"), F.md5("text").alias("digest"), "n_chars")
    path = fresh(t, "sketches")
    sinks.to_vector_store(sketches.sketched(rows, ["part", "batch"], "digest", "n_chars"), path)
    stored = t.spark.read.parquet(path)
    whole = sketches.estimated(sketches.merged(stored, [])).first()  # one row
    every = rows.agg(F.count_distinct("digest").alias("n")).first()["n"]
    spread = rows.withColumn("quantiles", F.lit(whole["quantiles"]))
    whole_off = sketches.rank_error(spread, [], "n_chars").first()["rank_error"]
    parts = sketches.estimated(sketches.merged(stored, ["part"]))
    ranks = sketches.rank_error(rows.join(parts.select("part", "quantiles"), "part"), ["part"], "n_chars")
    exact = rows.groupBy("part").agg(F.count_distinct("digest").alias("texts"))
    out = parts.join(exact, "part").join(ranks, "part")
    near = lambda guess, true: F.abs(guess - true) <= F.greatest(F.lit(2.0), sketches.DISTINCT_ERROR * true)
    within = near(F.col("distinct_estimate"), F.col("texts")) & near(F.lit(whole["distinct_estimate"]), F.lit(every))
    ranked = (F.col("rank_error") <= sketches.RANK_ERROR) & F.lit(whole_off <= sketches.RANK_ERROR)
    return out.select("part", "n", "texts", F.lit(every).cast("long").alias("all_texts"), within.alias("texts_within"), ranked.alias("ranks_within"))
