"""Queries that run an operator's own function on real rows, written tables or files, with SQL that states its rule."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import jobs
from ..functions import textnorm
from ..operators import answers, enrich, filters, retrieval, sampling, stats
from ..shared import shared_folder
from ..sources import files, sinks
from ..streaming import resume
from .registry import PAPERS, WHITE, Tables, papers, query

PROVIDER = enrich.OfflineProvider()


def fresh(t: Tables, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(t.spark)}/{name}-{uuid.uuid4().hex[:12]}"


def regions(t: Tables) -> DataFrame:
    """Regions as papers, their nations as questions."""
    n = t.nation.groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.array_sort(F.collect_list(F.struct(F.col("n_nationkey").cast("int").alias("question_number"), F.col("n_name").alias("question_text")))).alias("questions"))
    return t.region.join(n, "r_regionkey").select(F.col("r_regionkey").cast("string").alias("paper_id"), F.col("r_name").alias("name"), "questions")


@query(f"""
select doc_id, md5(regexp_replace(text || case doc_id % 3 when 0 then '  MathonGo x' when 1 then ' JEE main 2024 https://b' else '' end, '(?s)[{WHITE}]*(?:JEE Main 2024|MathonGo|https://).*', '')) as h from documents
""")
def q_strip_junk_exact(t: Tables) -> DataFrame:
    """The short list, letter case counting, on whole texts."""
    k = F.col("doc_id") % 3
    marked = F.concat("text", F.when(k == 0, "  MathonGo x").when(k == 1, " JEE main 2024 https://b").otherwise(""))
    return t.documents.select("doc_id", F.md5(textnorm.strip_junk(marked, textnorm.JUNK_MARKERS_SHORT, False)).alias("h"))


@query(f"select doc_id, md5(regexp_replace(regexp_replace(text, '[{WHITE}]{{2,}}', ' ', 'g'), '^[{WHITE}]+|[{WHITE}]+$', '', 'g')) as h from documents")
def q_collapse_spaces(t: Tables) -> DataFrame:
    """N9 on every whole text, Unicode white space."""
    return t.documents.select("doc_id", F.md5(textnorm.collapse_spaces("text")).alias("h"))


@query(r"select doc_id, regexp_replace(text, '(\d(?:\.\d+)?)[" + WHITE + r"]*%', '\1%', 'g') = text as same, length(regexp_replace(text, '(\d(?:\.\d+)?)[" + WHITE + r"]*%', '\1%', 'g'))::bigint as n from documents")
def q_close_percents(t: Tables) -> DataFrame:
    """N3 on every whole text."""
    out = textnorm.close_percents(F.col("text"))
    return t.documents.select("doc_id", (out == F.col("text")).alias("same"), F.length(out).cast("long").alias("n"))


@query(f"""
with {PAPERS} select paper_id, count(*) as n, count(*) filter (where event_id % 7 <> 0) as with_answer,
  coalesce(round(100.0::double * count(*) filter (where event_id % 7 <> 0) / nullif(count(*), 0), 1), 0) as coverage, grouping(paper_id)::int as is_total
from papers group by grouping sets ((paper_id), ())
""")
def q_answer_coverage(t: Tables) -> DataFrame:
    """A2."""
    items = papers(t).select("paper_id", F.when(F.col("event_id") % 7 != 0, F.col("answer")).alias("correct_answer"))
    return stats.answer_coverage(items).withColumn("is_total", F.col("is_total").cast("int"))


@query("select doc_id, len(regexp_extract_all(text, '# '))::bigint as headings, len(regexp_extract_all(text, '[$]'))::bigint as dollars, len(regexp_extract_all(text, '[$][^$]+[$]'))::bigint as formulas, len(regexp_extract_all(text, '[*][*]Q'))::bigint as questions, len(regexp_extract_all(text, chr(65533) || '|[(]cid:|□'))::bigint as garbled from documents")
def q_markdown_counters(t: Tables) -> DataFrame:
    """A14 on every whole text."""
    q = stats.markdown_quality("text")
    return t.documents.select("doc_id", *[q[c].cast("long").alias(c) for c in ("headings", "dollars", "formulas", "questions", "garbled")])


@query(f"""
with {PAPERS} select paper_id, ((n - 1) // 10)::int as batch, count(*)::int as n, string_agg(stem, '|' order by n) as texts, string_agg(((n - 1) % 10)::varchar, '|' order by n) as ids from papers group by 1, 2
""")
def q_tagging_prompts(t: Tables) -> DataFrame:
    """The prompts of batches of ten, read back."""
    items = papers(t).select("paper_id", "n", F.col("stem").alias("question_text"), "options")
    rows = enrich.prompt_batches(items, ["paper_id", "n"], "TAG")
    asked = F.from_json(F.substring_index("prompt", "\n", -1), "array<struct<id:int,text:string>>")
    return rows.select("paper_id", "batch", "n", F.array_join(F.transform(asked, lambda x: x.text), "|").alias("texts"), F.array_join(F.transform(asked, lambda x: x.id.cast("string")), "|").alias("ids"))


@query("select date_trunc('hour', ts) as start, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2")
def q_windowed_stream_plan(t: Tables) -> DataFrame:
    """The streaming window operator on a batch of events."""
    rows = resume.windowed(t.events, "1 hour")
    return rows.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("""
with g as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts, event_id) < interval '30 minutes' then 0 else 1 end as new, event_id from events),
s as (select user_id, ts, sum(new) over (partition by user_id order by ts, event_id rows unbounded preceding) as sid from g)
select user_id, min(ts) as start, count(*) as n from s group by user_id, sid
""")
def q_sessions_stream_plan(t: Tables) -> DataFrame:
    """The streaming session operator on a batch of events."""
    return resume.sessions(t.events).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("""
select p_partkey, p_name as text, p_size / 4 as x0, p_partkey % 100 / 4 as top, p_size / 4 + 10 as x1, p_partkey % 100 / 4 + 2.5 as bottom, 10.0::double as width, 2.5::double as height, 'text' as block_type from part
""")
def q_span_structs(t: Tables) -> DataFrame:
    """S2."""
    k = F.col("p_partkey") % 100
    rows = t.part.select("p_partkey", F.col("p_name").alias("t"), (F.col("p_size") / 4).alias("a"), (k / 4).alias("b"), (F.col("p_size") / 4 + 10).alias("c"), (k / 4 + 2.5).alias("d"))
    s = rows.select("p_partkey", files.span("t", ("a", "b", "c", "d")).alias("s"))
    c = "s.coordinates"
    return s.select("p_partkey", F.col("s.text").alias("text"), F.col(f"{c}.x0").alias("x0"), F.col(f"{c}.y0").alias("top"), F.col(f"{c}.x1").alias("x1"), F.col(f"{c}.y1").alias("bottom"), F.col(f"{c}.width").alias("width"), F.col(f"{c}.height").alias("height"), F.col("s.block_type").alias("block_type"))


def extractions(t: Tables) -> DataFrame:
    """Papers as extraction documents: stems as text blocks (every fifth is blank), an image for each fourth."""
    box = F.struct(*[F.lit(float(i)).alias(c) for i, c in enumerate(("x0", "y0", "x1", "y1", "width", "height"))])
    rows = papers(t).withColumn("page", F.expr("cast(n div 5 + 1 as int)"))
    text = F.when(F.col("n") % 5 == 0, "  ").otherwise(F.concat(F.lit(" "), "stem", F.lit(" ")))
    block = F.struct("n", F.struct("page", F.struct(text.alias("text"), box.alias("coordinates"), F.lit("text").alias("block_type")).alias("text")).alias("b"))
    image = F.when(F.col("n") % 4 == 0, F.struct("page", F.concat(F.lit("i"), F.col("n").cast("string"), F.lit(".png")).alias("filename"), F.lit(10).alias("width"), F.lit(20).alias("height")))
    return rows.groupBy("paper_id").agg(F.transform(F.array_sort(F.collect_list(block)), lambda x: x.b).alias("text_blocks"), F.array_sort(F.collect_list(image)).alias("images"))


@query(f"with {PAPERS} select paper_id, (n - 1)::int as pos, (n // 5 + 1)::int as page, stem as text from papers where n % 5 <> 0")
def q_text_spans(t: Tables) -> DataFrame:
    """One row a span that is not blank, in reading order."""
    return files.spans(extractions(t)).select("paper_id", "pos", "page", "text")


@query(f"with {PAPERS} select paper_id, (n // 5 + 1)::int as page, 'i' || n || '.png' as filename, 10 as width, 20 as height from papers where n % 4 = 0")
def q_images(t: Tables) -> DataFrame:
    """S3."""
    return files.images(extractions(t))


@query(f"""
with {PAPERS} select paper_id, max(n // 5 + 1)::int as total_pages, string_agg(stem, '|' order by n) filter (where n % 5 <> 0) as texts, string_agg('i' || n || '.png', '|' order by n // 5 + 1, 'i' || n || '.png') filter (where n % 4 = 0) as images from papers group by 1
""")
def q_composite_extraction(t: Tables) -> DataFrame:
    """Spans, images and page sizes as one document."""
    whole = extractions(t)
    sizes = files.page_sizes(papers(t).select("paper_id", F.expr("cast(n div 5 + 1 as int)").alias("page")).distinct().select("*", F.lit(595.0).alias("width"), F.lit(842.0).alias("height")))
    out = files.extraction(files.spans(whole), files.images(whole), sizes)
    joined = lambda c, f: F.array_join(F.transform(c, lambda x: x[f]), "|")
    return out.select("paper_id", "total_pages", joined("text_blocks", "text").alias("texts"), joined("images", "filename").alias("images"))


@query("select r_regionkey::varchar as paper_id, r_name as name, count(*) as n, string_agg(n_name, '|' order by n_nationkey) as texts from region join nation on n_regionkey = r_regionkey group by 1, 2")
def q_json_documents(t: Tables) -> DataFrame:
    """A folder a paper, read as nested JSON documents with a schema."""
    path = fresh(t, "json-documents")
    sinks.to_paper_folders(regions(t), path)
    rows = files.documents_json(t.spark, path, "name string, questions array<struct<question_number:int,question_text:string>>")
    return rows.where("_corrupt_record is null").select(F.regexp_extract("source_path", "paper_id=([^/]+)/", 1).alias("paper_id"), "name", F.size("questions").cast("long").alias("n"), F.array_join(F.transform("questions", lambda q: q.question_text), "|").alias("texts"))


@query("select 'paper_id=' || r_regionkey as folder, (select count(*) from region) as files, 3::bigint as limited, 1::bigint as latest from region")
def q_discovery(t: Tables) -> DataFrame:
    """S9 (by pattern, by prefix and content, with a limit), L7."""
    path = fresh(t, "folders")
    sinks.to_paper_folders(regions(t), path)
    n = [files.discovered(t.spark, path, "part-*.json").count(), files.discovered(t.spark, path, "part-*.json", 3).count(), sampling.latest_file(t.spark, f"{path}/*", "part-*.json").count()]
    return files.paper_folders(t.spark, path, "paper_id=", "part-*.json").select("folder", *[F.lit(x).cast("long").alias(c) for x, c in zip(n, ("files", "limited", "latest"), strict=True)])


@query("select row_number() over (order by n_name) - 1 as _idx, n_nationkey as question_number, n_name as question_text from nation")
def q_jsonl_ordinal(t: Tables) -> DataFrame:
    """The physical line of each object."""
    path = fresh(t, "ordinal")
    rows = t.nation.orderBy("n_name").select(F.col("n_nationkey").cast("int").alias("question_number"), F.col("n_name").alias("question_text")).coalesce(1)
    sinks.to_jsonl(rows, path)
    return files.jsonl_with_ordinal(t.spark, path).select("_idx", F.col("question_number").cast("long").alias("question_number"), "question_text")


@query("select r_name as line from region")
def q_whole_texts(t: Tables) -> DataFrame:
    """S11."""
    path = fresh(t, "texts")
    t.region.select("r_name").repartition(3, "r_name").write.text(path)
    return files.whole_texts(t.spark, path, "part-*").select(F.explode(F.split("content", "\n")).alias("line")).where("line <> ''")


@query("select upper(r_name) as text, null::varchar as error from region")
def q_converted_files(t: Tables) -> DataFrame:
    """Files through an external converter."""
    path = fresh(t, "convert")
    t.region.select("r_name").repartition(3, "r_name").write.text(path)

    def upper(name: str, content: bytes) -> list[tuple[int, int, str]]:
        return [(i, 1, x.upper()) for i, x in enumerate(content.decode().splitlines())]

    return files.converted(t.spark, path, "part-*", upper).select("text", "error")


@query("select n_regionkey, count(*) as n from nation group by 1")
def q_cached_table(t: Tables) -> DataFrame:
    """Made once, then read."""
    path = fresh(t, "cached")
    files.cached(t.spark, path, lambda: t.nation.groupBy("n_regionkey").agg(F.count("*").alias("n")))

    def never() -> DataFrame:
        raise AssertionError("the table is there already")

    return files.cached(t.spark, path, never)


@query("select r_regionkey::varchar as paper_id, (n_nationkey + 1)::int as question_number, (n_nationkey % 4 + 1)::varchar as answer from region join nation on n_regionkey = r_regionkey")
def q_answer_key_files(t: Tables) -> DataFrame:
    """Answer keys from extraction files whose blocks hold text as an object or a string."""
    path = fresh(t, "keys")
    line = F.concat(F.lit("Q"), (F.col("n_nationkey") + 1).cast("string"), F.lit(". ("), (F.col("n_nationkey") % 4 + 1).cast("string"), F.lit(")"))
    block = F.when(F.col("n_nationkey") % 2 == 0, F.to_json(F.struct(line.alias("text")))).otherwise(F.to_json(F.struct(F.struct(line.alias("text")).alias("text"))))
    rows = t.nation.groupBy("n_regionkey").agg(F.array_join(F.array_sort(F.collect_list(block)), ",").alias("b"))
    rows.repartition(5, "n_regionkey").select(F.concat(F.lit('{"paper_id": "'), F.col("n_regionkey").cast("string"), F.lit('", "text_blocks": ['), "b", F.lit("]}")).alias("value"), F.col("n_regionkey").alias("p")).write.partitionBy("p").text(path)
    return files.answer_key_file(t.spark, path, "part-*")


@query(f"with {PAPERS} select paper_id as source_file, (n % 5)::int as question_number, arg_max(answer, n) as raw_answer from papers group by 1, 2")
def q_raw_answers(t: Tables) -> DataFrame:
    """Nested answers, the last of repeated numbers counting; a number that is none falls out."""
    one = F.struct("n", F.struct(F.when(F.col("n") % 5 < 5, (F.col("n") % 5).cast("string")).alias("question_number"), F.col("answer").alias("correct_answer")).alias("q"))
    nested = papers(t).groupBy(F.col("paper_id").alias("source_file")).agg(F.transform(F.array_sort(F.collect_list(one)), lambda x: x.q).alias("q"))
    bad = F.array(F.struct(F.lit("x").alias("question_number"), F.lit("9").alias("correct_answer")))
    return answers.raw_answers(nested.select("source_file", F.concat("q", bad).alias("questions")))


@query("select count(*) as rows, sum(n)::bigint as n, sum(k)::bigint as k from (select n_regionkey as paper_id, count(*) as n, sum(n_nationkey) as k from nation group by 1)")
def q_stats_json(t: Tables) -> DataFrame:
    """Totals of the written statistics."""
    path = fresh(t, "stats")
    rows = t.nation.groupBy(F.col("n_regionkey").cast("string").alias("paper_id")).agg(F.count("*").alias("n"), F.sum("n_nationkey").alias("k"))
    sinks.to_stats_json(rows, path)
    lines = t.spark.read.schema("paper_id string, n long, k long").json(f"{path}/per_paper").count()
    return t.spark.read.schema("rows long, n long, k long").json(f"{path}/totals").where(F.col("rows") == lines)


@query(f"with {PAPERS} select paper_id, count(*) as total_questions, string_agg(stem, '|' order by n) as texts from papers group by 1")
def q_consolidated_json(t: Tables) -> DataFrame:
    """One line a paper, written and read."""
    path = fresh(t, "consolidated")
    items = papers(t).select("paper_id", F.col("n").alias("question_number"), "stem", F.lit("verified").alias("status"))
    sinks.to_consolidated_json(stats.consolidated(items), path)
    back = t.spark.read.schema("paper_id string, total_questions long, questions array<struct<question_number:int,stem:string>>").json(path)
    return back.select("paper_id", "total_questions", F.array_join(F.transform("questions", lambda q: q.stem), "|").alias("texts"))


@query(f"with {PAPERS} select paper_id, count(*) as total_questions, 'markdown' as parsing_method, string_agg(n::varchar, '|' order by n) as numbers from papers group by 1")
def q_parsed_json(t: Tables) -> DataFrame:
    """A document a paper with its header, written and read."""
    path = fresh(t, "parsed")
    sinks.to_parsed_json(papers(t).select("paper_id", F.col("n").alias("question_number"), "stem"), path)
    back = t.spark.read.schema("paper_id string, total_questions long, parsing_method string, questions array<struct<question_number:int>>").json(path)
    return back.select("paper_id", "total_questions", "parsing_method", F.array_join(F.transform("questions", lambda q: q.question_number.cast("string")), "|").alias("numbers"))


@query("select vec_id, 'v' || vec_id as meta, len(embedding)::int as dim from embeddings")
def q_vector_store(t: Tables) -> DataFrame:
    """Vectors with their mapping, written and read."""
    path = fresh(t, "vectors")
    sinks.to_vector_store(t.embeddings.select("vec_id", "embedding", F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("meta")), path)
    return t.spark.read.parquet(path).select("vec_id", "meta", F.size("embedding").alias("dim"))


@query("select doc_id, length(coalesce(text, ''))::double as length from documents")
def q_encoded_texts(t: Tables) -> DataFrame:
    """Every whole text through an encoder."""
    rows = retrieval.embedded(t.documents.select("doc_id", "text"), "text", lambda texts: [[float(len(x))] for x in texts])
    return rows.select("doc_id", F.col("embedding")[0].cast("double").alias("length"))


@query("select doc_id as vec_id, ((length(coalesce(text, '')) - 200) * (length(coalesce(text, '')) - 200))::double as d2 from documents order by d2, vec_id limit 7")
def q_text_search(t: Tables) -> DataFrame:
    """L5 for a query in words, through the store's encoder."""
    by_length = lambda texts: [[float(len(x))] for x in texts]
    store = retrieval.embedded(t.documents.select(F.col("doc_id").alias("vec_id"), "text"), "text", by_length)
    return retrieval.search_text(store, "x" * 200, 7, by_length).select("vec_id", "d2")


@query(f"with {PAPERS} select paper_id, n::bigint as n from papers where event_id % 3 <> 0 order by md5('5|' || paper_id || '|' || n), paper_id, n limit 25")
def q_mcq_sample(t: Tables) -> DataFrame:
    """MCQs alone, then a reproducible sample."""
    items = papers(t).select("paper_id", "n", F.when(F.col("event_id") % 3 == 0, "integer").otherwise("mcq").alias("question_type"))
    return sampling.sample_n(filters.mcq_only(items), 25, 5, "paper_id", "n").select("paper_id", F.col("n").cast("long").alias("n"))


@query("select o_custkey as paper_id, count(*) as n from orders group by 1")
def q_papers_with_items(t: Tables) -> DataFrame:
    """papers without items are skipped."""
    some = t.orders.groupBy("o_custkey").agg(F.collect_list("o_orderkey").alias("questions"))
    rows = t.customer.join(some, F.col("c_custkey") == F.col("o_custkey"), "left").select(F.col("c_custkey").alias("paper_id"), "questions")
    return filters.with_items(rows).select("paper_id", F.size("questions").cast("long").alias("n"))


@query(f"with {PAPERS} select paper_id, n::bigint as question_number, case when n % 2 = 1 then answer end as answer_raw from papers")
def q_attach_key(t: Tables) -> DataFrame:
    """A key that covers odd numbers."""
    items = papers(t).select("paper_id", F.col("n").alias("question_number"))
    key = papers(t).where("n % 2 = 1").select("paper_id", F.col("n").alias("question_number"), "answer")
    return answers.attach_key(items, key).select("paper_id", F.col("question_number").cast("long").alias("question_number"), "answer_raw")


@query("(select 'papers' as of_what, o_orderkey as id from orders order by o_orderkey limit 12) union all (select 'items', doc_id from documents order by doc_id limit 5)")
def q_heads(t: Tables) -> DataFrame:
    """L3, L8."""
    a = sampling.head(t.orders.select(F.lit("papers").alias("of_what"), F.col("o_orderkey").alias("id")), 12, "id")
    return a.unionAll(sampling.head(t.documents.select(F.lit("items").alias("of_what"), F.col("doc_id").alias("id")), 5, "id"))


@query(f"with {PAPERS} select event_id % 3 as pool, count(*) as n, sum(event_id)::bigint as ids from papers group by 1")
def q_pool_flatten(t: Tables) -> DataFrame:
    """Buckets put end to end, columns matched by name."""
    rows = papers(t).select((F.col("event_id") % 3).alias("pool"), "event_id")
    parts = [rows.where(F.col("pool") == i) for i in (0, 1)] + [rows.where("pool = 2").select("event_id", "pool")]
    return sampling.union_all(*parts).groupBy("pool").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


@query(f"""
with {PAPERS} select paper_id, n::bigint as question_number, 'Mathematics' as subject, case length(stem) % 3 when 0 then 'easy' when 1 then 'medium' else 'hard' end as difficulty,
  case answer when '1' then o1 when '2' then o2 when '3' then o3 else o4 end as correct_text from papers
""")
def q_item_metadata(t: Tables) -> DataFrame:
    """Metadata of single items and the right option's text."""
    options = F.transform(F.col("options"), lambda x, i: F.struct((i + 1).cast("string").alias("id"), x.alias("text")))
    items = papers(t).select("paper_id", "n", F.col("stem").alias("question_prompt"), options.alias("options"), F.col("answer").alias("correct_option_id"))
    out = enrich.metadata_of(items, PROVIDER)
    return out.select("paper_id", F.col("n").cast("long").alias("question_number"), F.col("metadata.subject").alias("subject"), F.col("metadata.difficulty").alias("difficulty"), F.col("answer_details.correct_option_text").alias("correct_text"))


class Picky:
    """Answers stems of even length and fails on the others."""

    def complete(self, prompt: str) -> str:
        text = prompt.partition("\n")[2]
        if len(text) % 2:
            raise RuntimeError("no answer")
        return "Work: " + text


@query(f"with {PAPERS} select paper_id, n::bigint as n, case when length(stem) % 2 = 0 then 'Work: ' || stem else 'Error: no solution' end as solution from papers")
def q_solutions(t: Tables) -> DataFrame:
    """Solutions, a failure being text, too."""
    out = enrich.solutions(papers(t).select("paper_id", "n", F.col("stem").alias("question_text")), Picky())
    return out.select("paper_id", F.col("n").cast("long").alias("n"), "solution")


@query(f"""
with {PAPERS} select paper_id, count(*) as total_questions, count(*) filter (where event_id % 2 = 0) as verified, string_agg(case when n % 3 = 0 then 'k' || n else answer end, '|' order by n) as answers from papers group by 1
""")
def q_final_consolidation(t: Tables) -> DataFrame:
    """The key's answers override, then one row per paper."""
    items = papers(t).select("paper_id", F.col("n").alias("question_number"), F.col("answer").alias("correct_answer"), F.when(F.col("event_id") % 2 == 0, "verified").otherwise("mismatch").alias("status"))
    key = papers(t).where("n % 3 = 0").select("paper_id", F.col("n").alias("question_number"), F.concat(F.lit("k"), F.col("n").cast("string")).alias("answer"))
    out = stats.final_consolidation(items, key)
    return out.select("paper_id", "total_questions", "verified", F.array_join(F.transform("questions", lambda q: q.correct_answer), "|").alias("answers"))


@query("""
with d as (select user_id as run, count(*) over w as n, (sum(event_id % 7 + 1) over w)::bigint as elapsed, count(*) over (partition by user_id) as total from events
  window w as (partition by user_id order by event_id rows unbounded preceding))
select run, n, elapsed, n::double / elapsed as rate, (total - n)::double / (n::double / elapsed) as eta from d where n % 10 = 0 or n = total
""")
def q_run_progress(t: Tables) -> DataFrame:
    """Rate and time left after every tenth row."""
    done = t.events.select(F.col("user_id").alias("run"), F.col("event_id").alias("nth"), (F.col("event_id") % 7 + 1).alias("seconds"))
    return stats.progress(done, done.groupBy("run").agg(F.count("*").alias("total")))


@query("select source, count(*) as n, sum(length(trim(text)))::bigint as chars, 'success,success,kept,kept' as report from documents group by 1")
def q_staged_job(t: Tables) -> DataFrame:
    """O1: two stages, each stored; a second run finds both."""
    root = fresh(t, "stages")
    stages = [("trim", lambda d: d.select("source", F.trim("text").alias("text"))), ("sum", lambda d: d.groupBy("source").agg(F.count("*").alias("n"), F.sum(F.length("text").cast("long")).alias("chars")))]
    docs = t.documents.select("source", "text")
    first, second = jobs.run_stages(docs, stages, root), jobs.run_stages(docs, stages, root)
    report = ",".join(r["status"] for r in first[1] + second[1])
    return second[0].withColumn("report", F.lit(report))


@query("select 5::bigint as total, count(*) filter (where r_name <> 'ASIA') as successful, count(*) filter (where r_name = 'ASIA') as failed, round(100.0::double * count(*) filter (where r_name <> 'ASIA') / count(*), 2) as success_rate, string_agg(case r_name when 'ASIA' then 'error' else 'success' end, ',' order by r_name) as statuses from region")
def q_batch_runner(t: Tables) -> DataFrame:
    """A job for each region, side by side and in turn; the one that fails is its own row."""

    def job(name: str) -> int:
        if name == "ASIA":
            raise ValueError("unreadable")
        return t.region.where(F.col("r_name") == name).count()

    names = [r["r_name"] for r in t.region.orderBy("r_name").collect()]
    side, turn = jobs.run_batch(names, job, 3), jobs.run_batch(names, job)
    same = [x["status"] for x in side] == [x["status"] for x in turn]
    statuses = ",".join(x["status"] for x in side) if same else "different"
    return jobs.summary(t.spark, side).select("total", "successful", "failed", "success_rate", F.lit(statuses).alias("statuses"))


@query("select 'paper_id=' || r_regionkey as folder, case when r_regionkey = 2 then 'error' else 'success' end as status from region")
def q_folder_post_process(t: Tables) -> DataFrame:
    """A job for each paper folder, errors kept apart."""
    path = fresh(t, "post")
    sinks.to_paper_folders(regions(t), path)

    def job(folder: str) -> None:
        if folder.endswith("=2"):
            raise ValueError("bad folder")
        t.spark.read.schema("name string").json(folder).count()

    rows = jobs.post_process(t.spark, path, "paper_id=", "part-*.json", job, 2)
    return t.spark.createDataFrame([(r["name"], r["status"]) for r in rows], "folder string, status string")


@query(f"with {PAPERS} select paper_id, n::bigint as question_number, case length(stem) % 3 when 0 then 'easy' when 1 then 'medium' else 'hard' end as difficulty, 1::bigint as times from papers")
def q_resumable_tagging(t: Tables) -> DataFrame:
    """Tagged in two calls, the second one taking up what the first left; each item once."""
    out = fresh(t, "tagging")
    items = papers(t).select("paper_id", F.col("n").alias("question_number"), F.col("stem").alias("question_text"), "options")
    enrich.tagged_into(items.where("question_number <= 10"), PROVIDER, ["paper_id", "question_number"], out)
    rows = enrich.tagged_into(items, PROVIDER, ["paper_id", "question_number"], out)
    return rows.groupBy("paper_id", F.col("question_number").cast("long").alias("question_number"), "difficulty").agg(F.count("*").alias("times"))
