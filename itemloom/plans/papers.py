"""Queries over constructed papers, vectors, conversations and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import chemistry, latex, prompts, textnorm
from ..operators import answers, filters, render, retrieval, segment, stats
from ..operators.enrich import OfflineProvider, tagged
from ..shared import shared_folder
from .registry import PAPERS, Tables, paper_spans, papers, query


@query(f"with {PAPERS} select paper_id, n::bigint as question_number, stem as question_text, o1 || '|' || o2 || '|' || o3 || '|' || o4 as options, (n // 5 + 1)::bigint as page_start from papers")
def q_segment_blocks(t: Tables) -> DataFrame:
    """Spans back to the items that they were made from."""
    items = segment.marker_items(paper_spans(t))
    return items.select("paper_id", F.col("question_number").cast("long").alias("question_number"), "question_text", F.array_join("options", "|").alias("options"), F.col("page_start").cast("long").alias("page_start"))


@query(f"with {PAPERS} select paper_id, n::bigint as question_number, stem, o1 || '|' || o2 || '|' || o3 || '|' || o4 as options from papers")
def q_inline_options(t: Tables) -> DataFrame:
    """Options inside one line, given out of order for every other item."""
    o = lambda i: F.concat(F.lit(f" ({i}) "), F.col("options")[i - 1])
    line = F.concat("stem", F.when(F.col("n") % 2 == 0, F.concat(*[o(i) for i in (2, 1, 4, 3)])).otherwise(F.concat(*[o(i) for i in (1, 2, 3, 4)])))
    rows = papers(t).withColumn("x", segment.inline_options(line))
    return rows.select("paper_id", F.col("n").cast("long").alias("question_number"), "x.stem", F.array_join("x.options", "|").alias("options"))


@query(f"""
with {PAPERS}, k as (select paper_id, n, answer, hash_kind from (select *, length(paper_id) % 3 as hash_kind, count(*) over (partition by paper_id) as c from papers) where hash_kind < 2 or c >= 10)
select paper_id, n::bigint as question_number, answer from k
""")
def q_answer_key_priority(t: Tables) -> DataFrame:
    """Keys in three formats."""
    kind = F.length("paper_id") % 3
    line = F.when(kind == 0, F.format_string("Q%d. (%s)", "n", "answer")).when(kind == 1, F.format_string("%d) (%s)", "n", "answer")).otherwise(F.format_string("(%s)", "answer"))
    texts = papers(t).groupBy("paper_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", line.alias("l")))), lambda x: x.l), "\n").alias("text"))
    return answers.answer_key(texts).select("paper_id", F.col("question_number").cast("long").alias("question_number"), "answer")


@query(f"with {PAPERS} select paper_id, (n % 7)::bigint as question_number, arg_max(answer || 'x', n) as answer from papers group by 1, 2")
def q_answer_key_last_wins(t: Tables) -> DataFrame:
    """Of repeated numbers the last answer counts."""
    line = F.format_string("%d. (%sx)", F.col("n") % 7, "answer")
    texts = papers(t).groupBy("paper_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", line.alias("l")))), lambda x: x.l), " ").alias("text"))
    return answers.dotted_key(texts).select("paper_id", F.col("question_number").cast("long").alias("question_number"), "answer")


@query(f"with {PAPERS} select paper_id, n::bigint as question_number, case answer when '1' then o1 when '2' then o2 when '3' then o3 else o4 end as correct_text from papers")
def q_option_lookup(t: Tables) -> DataFrame:
    """J14."""
    listed = F.transform("options", lambda x, i: F.struct((i + 1).cast("string").alias("id"), x.alias("text")))
    rows = papers(t).withColumn("o", listed)
    return rows.select("paper_id", F.col("n").cast("long").alias("question_number"), prompts.correct_text("o", "answer").alias("correct_text"))


@query(f"""
with {PAPERS}, pics as (select distinct paper_id, n // 5 + 1 as page, 'img_' || (n // 5 + 1) || '.png' as filename from papers where (n // 5) % 2 = 0)
select p.paper_id, p.n::bigint as question_number, coalesce(i.filename, '') as images from papers p left join pics i on p.paper_id = i.paper_id and p.n // 5 + 1 = i.page
""")
def q_image_page_join(t: Tables) -> DataFrame:
    """J5 as intended: images of the pages that an item covers."""
    items = segment.marker_items(paper_spans(t))
    page = F.expr("cast(n div 5 + 1 as int)")
    pics = papers(t).where("(n div 5) % 2 = 0").select("paper_id", page.alias("page")).distinct().withColumn("filename", F.format_string("img_%d.png", "page"))
    out = answers.with_page_values(items, pics, "filename", "images")
    return out.select("paper_id", F.col("question_number").cast("long").alias("question_number"), F.array_join("images", "|").alias("images"))


MARKDOWN = "Q%d. %s\n\n(1) %s\n(2) %s\n(3) %s\n(4) %s\n\nAnswer: (%s)\n"


@query(f"""
with {PAPERS} select paper_id, n::bigint as question_number, paper_id || '_q' || n as question_id, stem || ':' as question_latex, o1 || '|' || o2 || '|' || o3 || '|' || o4 as options, answer as correct_answer, 'Mathematics' as subject from papers
""")
def q_markdown_items(t: Tables) -> DataFrame:
    """Whole markdown files to items."""
    section = F.format_string(MARKDOWN, F.col("n"), "stem", *[F.col("options")[i] for i in range(4)], "answer")
    pages = papers(t).groupBy("paper_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", section.alias("s")))), lambda x: x.s), "\n").alias("content"))
    out = segment.markdown_items(pages)
    return out.select("paper_id", F.col("question_number").cast("long").alias("question_number"), "question_id", "question_latex", F.array_join(F.transform("options", lambda o: o.text), "|").alias("options"), "correct_answer", "subject")


@query(f"with {PAPERS} select paper_id, (n % 5)::bigint as question_number, arg_max(stem, n) as prompt, arg_max(o1 || '|' || o2, n) as options from papers group by 1, 2")
def q_question_blocks(t: Tables) -> DataFrame:
    """Blocks by number, prompt and options."""
    block = F.format_string("Q%d. %s\n(A) %s\n(B) %s\n", F.col("n") % 5, "stem", F.col("options")[0], F.col("options")[1])
    texts = papers(t).groupBy("paper_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", block.alias("s")))), lambda x: x.s), "").alias("content"))
    out = segment.question_blocks(texts).withColumn("x", segment.prompt_and_options("block"))
    return out.select("paper_id", F.col("question_number").cast("long").alias("question_number"), "x.prompt", F.array_join(F.transform("x.options", lambda o: o.text), "|").alias("options"))


@query(f"""
with {PAPERS}, r as (select paper_id, max(n // 5 + 1) as last from papers group by 1)
select p.paper_id, string_agg(case when p.n // 5 + 1 < r.last then p.stem end, chr(10) order by n) as body, string_agg(case when p.n // 5 + 1 = r.last then p.stem end, chr(10) order by n) as key
from papers p join r using (paper_id) group by 1
""")
def q_last_page_key(t: Tables) -> DataFrame:
    """Body pages and key page of a paper."""
    spans = papers(t).select("paper_id", F.col("n").alias("pos"), F.expr("cast(n div 5 + 1 as int)").alias("page"), F.col("stem").alias("text"))
    out = segment.split_last_page(spans)
    return out.select("paper_id", F.nullif("body", F.lit("")).alias("body"), "key")


@query("select conv_id as source_file, turn as page_number, row_number() over (partition by conv_id order by length(text), role, text, turn) as pos from conversations")
def q_reading_order(t: Tables) -> DataFrame:
    """One list in order of place."""
    e = t.conversations.select(F.col("conv_id").alias("source_file"), F.col("turn"), F.lit(1).alias("page_number"), F.length("text").alias("top"), F.col("role").alias("x0"), "text", F.col("turn").alias("path"))
    return segment.reading_order(e).select("source_file", F.col("turn").alias("page_number"), F.col("pos").cast("long").alias("pos"))


@query("""
with q as (select embedding as q from embeddings where vec_id = 0),
d as (select vec_id, list_sum(list_transform(list_zip(embedding, q), lambda x: (x[1]::double - x[2]::double) * (x[1]::double - x[2]::double))) as d2 from embeddings, q)
select vec_id, round(d2, 4) as d2 from d order by d.d2, vec_id limit 10
""")
def q_knn_single(t: Tables) -> DataFrame:
    """The query is a literal; k rows a partition move."""
    q = t.embeddings.where("vec_id = 0").select("embedding").first()[0]
    return retrieval.nearest_to(t.embeddings, q, 10).select("vec_id", F.round("d2", 4).alias("d2"))


@query("""
with q as (select vec_id as query_id, embedding as q from embeddings where vec_id % 20 = 0),
d as (select query_id, vec_id, list_sum(list_transform(list_zip(embedding, q), lambda x: (x[1]::double - x[2]::double) * (x[1]::double - x[2]::double))) as d2 from embeddings, q),
r as (select *, row_number() over (partition by query_id order by d2, vec_id) as rank from d)
select r.query_id, r.vec_id, r.rank::bigint as rank, e.label from r join embeddings e using (vec_id) where r.rank <= 5
""")
def q_knn_batch_all(t: Tables) -> DataFrame:
    """Every row whose id is divisible by 20 against all vectors, then their documents."""
    q = t.embeddings.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    hits = retrieval.nearest_batch(t.embeddings, q, 5)
    return hits.join(t.embeddings.select("vec_id", "label"), "vec_id").select("query_id", "vec_id", F.col("rank").cast("long").alias("rank"), "label")


@query("""
select conv_id, string_agg(text, chr(10) || '---' || chr(10) order by turn) as context, count(*) as n
from (select *, row_number() over (partition by conv_id order by turn) as nth from conversations) where nth <= 3 group by 1
""")
def q_context_top3(t: Tables) -> DataFrame:
    """L6."""
    return retrieval.context(t.conversations, "text", ["conv_id"], ["turn"], 3)


VALID = "case doc_id % 6 when 0 then '$x$ and {y}' when 1 then '$x' when 2 then '}{' when 3 then '{{}' when 4 then '\\mathbb{R}' else '$a$ $b$ $c$ $d$ $e$' end"


@query("""
select doc_id, case doc_id % 6 when 0 then '' when 1 then 'Unbalanced $ signs' when 2 then 'Unbalanced braces (extra })' when 3 then 'Unbalanced braces (missing })'
       when 4 then 'Contains \\mathbb (broken output)' else 'Severely fragmented math' end as error, doc_id % 6 <> 1 and doc_id % 6 <> 3 as balanced from documents
""")
def q_latex_validate(t: Tables) -> DataFrame:
    """V1, V3."""
    k = F.col("doc_id") % 6
    text = F.when(k == 0, "$x$ and {y}").when(k == 1, "$x").when(k == 2, "}{").when(k == 3, "{{}").when(k == 4, r"\mathbb{R}").otherwise("$a$ $b$ $c$ $d$ $e$")
    return t.documents.select("doc_id", latex.latex_error(text).alias("error"), latex.counts_balanced(text).alias("balanced"))


@query(r"""
select doc_id, doc_id % 10 as id, 'Physics' as subject, '\frac' as topic, 'easy' as difficulty from documents where doc_id % 3 <> 2
""")
def q_json_repair(t: Tables) -> DataFrame:
    """Fenced JSON with lone backslashes; a wrong length gives nothing."""
    one = F.format_string('{"id": %d, "subject": "Physics", "topic": "\\frac", "difficulty": "easy"}', F.col("doc_id") % 10)
    raw = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("```json\n["), one, F.lit("]\n```"))).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("["), one, F.lit("]"))).otherwise(F.concat(F.lit("["), one, F.lit(","), one, F.lit("]")))
    rows = t.documents.select("doc_id", F.explode(prompts.parse_answers(raw, "struct<id:bigint,subject:string,topic:string,difficulty:string>", F.lit(1))).alias("x"))
    return rows.select("doc_id", "x.*")


@query(r"""
select doc_id, replace(replace(replace(replace(replace('a & b_' || doc_id || ' 5% {x} #1', '&', '\&'), '%', '\%'), '#', '\#'), '_', '\_'), '{x}', '\{x\}') as plain,
       '$\alpha$ \& ' || doc_id as greek from documents
""")
def q_latex_escape(t: Tables) -> DataFrame:
    """N23, N24."""
    n = F.col("doc_id").cast("string")
    return t.documents.select("doc_id", latex.escape_latex(F.concat(F.lit("a & b_"), n, F.lit(" 5% {x} #1"))).alias("plain"), latex.escape_latex(F.concat(F.lit("α & "), n)).alias("greek"))


@query(f"""
with {PAPERS} select paper_id, n::bigint as number, '\\question' || chr(10) || stem || chr(10) || '\\begin{{choices}}' || chr(10) || '  \\choice ' || o1 || chr(10) || '  \\choice ' || o2 || chr(10) || '  \\choice ' || o3 || chr(10) || '  \\choice ' || o4 || chr(10) || '\\end{{choices}}' || chr(10) as latex from papers
""")
def q_render_questions(t: Tables) -> DataFrame:
    """G1."""
    return papers(t).select("paper_id", F.col("n").cast("long").alias("number"), render.item_latex("stem", "options", F.lit("mcq")).alias("latex"))


PAPER_SQL = f"""
with {PAPERS},
items as (
  select paper_id, n, stem, o1, o2, o3, o4, answer, case when event_id % 3 = 0 then 'integer' else 'mcq' end as kind,
         case n % 3 when 0 then 'Physics' when 1 then 'Chemistry' else 'Mathematics' end as subject, case when event_id % 2 = 0 then 'easy' else 'hard' end as difficulty,
         md5('11|' || paper_id || '|' || n) as h from papers),
cells as (select *, row_number() over (partition by subject, kind, difficulty order by h, paper_id, n) as c from items),
chosen as (select *, case kind when 'mcq' then 0 else 1 end as part, case subject when 'Physics' then 0 when 'Chemistry' then 1 else 2 end as place from cells where c <= case kind when 'mcq' then 6 else 3 end),
ranked as (select *, row_number() over (partition by place, part order by h, paper_id, n) as nth from chosen),
numbered as (select *, row_number() over (order by place, part, nth) as number from ranked where nth <= case part when 0 then 20 else 10 end),
lined as (select *, lag(place) over (order by number) as last, row_number() over (partition by part order by number) as rn from numbered),
texts as (
  select number, part, case when last is distinct from place then '\\section*{{' || subject || '}}' || chr(10) else '' end || '\\question' || chr(10) || stem || chr(10)
    || case part when 0 then '\\begin{{choices}}' || chr(10) || '  \\choice ' || o1 || chr(10) || '  \\choice ' || o2 || chr(10) || '  \\choice ' || o3 || chr(10) || '  \\choice ' || o4 || chr(10) || '\\end{{choices}}' || chr(10) else '' end as body,
    number || '. ' || answer || case when rn % 10 = 0 then ' \\\\' || chr(10) else ' & ' end as cell,
    '\\textbf{{' || number || '.}} ' || stem || chr(10) as worked
  from lined)
select '\\documentclass{{exam}}' || chr(10) || '\\usepackage{{amsmath}}' || chr(10) || '\\begin{{document}}' || chr(10) || '\\title{{Practice Paper}}' || chr(10) || '\\begin{{questions}}' || chr(10)
  || string_agg(body, '' order by number) || '\\end{{questions}}' || chr(10)
  || '\\section*{{Answers: multiple choice}}' || chr(10) || '\\begin{{tabular}}{{llllllllll}}' || chr(10) || coalesce(string_agg(cell, '' order by number) filter (where part = 0), '') || chr(10) || '\\end{{tabular}}' || chr(10)
  || '\\section*{{Answers: integer}}' || chr(10) || '\\begin{{tabular}}{{llllllllll}}' || chr(10) || coalesce(string_agg(cell, '' order by number) filter (where part = 1), '') || chr(10) || '\\end{{tabular}}' || chr(10)
  || '\\section*{{Solutions}}' || chr(10) || string_agg(worked, '' order by number) || '\\end{{document}}' || chr(10) as document, count(*) as n_questions
from texts
"""


@query(PAPER_SQL)
def q_generate_paper(t: Tables) -> DataFrame:
    """One rendered paper with its answer tables and solutions."""
    k = F.col("n") % 3
    items = papers(t).select(
        "paper_id", F.col("n").alias("question_number"), F.col("stem").alias("question_text"), "options", F.when(F.col("event_id") % 3 == 0, "integer").otherwise("mcq").alias("question_type"),
        F.col("answer").cast("int").alias("correct_index"), F.lit(None).cast("int").alias("correct_answer"), F.when(k == 0, "Physics").when(k == 1, "Chemistry").otherwise("Mathematics").alias("subject"),
        F.lit("General").alias("topic"), F.when(F.col("event_id") % 2 == 0, "easy").otherwise("hard").alias("difficulty"), F.lit(2024).alias("year"),
    )
    return render.generate_paper(items, "balanced", 11, solver=OfflineProvider())


@query("""
with s as (select p_partkey, 'C' || repeat('N', (p_partkey % 3)::int) || '(=O)Cl' || case when p_partkey % 4 = 0 then '(' else '' end as s from part)
select p_partkey, case when p_partkey % 4 = 0 then 'Unbalanced parentheses' end as error, round(2 * 12.011::double + (p_partkey % 3) * 14.007::double + 15.999::double + 35.45::double, 2) as weight,
       array_to_string(list_sort(list_distinct(regexp_extract_all(s, '[A-Z][a-z]?'))), ',') as elements from s
""")
def q_smiles_stats(t: Tables) -> DataFrame:
    """V4, N34, N35."""
    k = F.col("p_partkey")
    s = F.concat(F.lit("C"), F.repeat(F.lit("N"), (k % 3).cast("int")), F.lit("(=O)Cl"), F.when(k % 4 == 0, "(").otherwise(""))
    return t.part.select("p_partkey", chemistry.smiles_error(s).alias("error"), chemistry.weight_estimate(s).alias("weight"), F.array_join(chemistry.elements(F.array(s)), ",").alias("elements"))


@query(f"""
with {PAPERS} select paper_id, count(*) as total_questions, count(*) filter (where event_id % 2 = 0) as verified, string_agg(n::varchar, ',' order by n) as numbers,
       coalesce(round(100.0 * count(*) filter (where event_id % 2 = 0) / nullif(count(*), 0), 2), 0) as rate from papers group by 1
""")
def q_consolidate_papers(t: Tables) -> DataFrame:
    """A6."""
    items = papers(t).select("paper_id", F.col("n").alias("question_number"), F.when(F.col("event_id") % 2 == 0, "verified").otherwise("mismatch").alias("status"))
    out = stats.consolidated(items)
    return out.select("paper_id", "total_questions", "verified", F.array_join(F.transform("questions", lambda q: q.question_number.cast("string")), ",").alias("numbers"), "rate")


@query(f"""
with {PAPERS} select paper_id, n::bigint as question_number, 'Mathematics' as subject, case length(stem) % 3 when 0 then 'easy' when 1 then 'medium' else 'hard' end as difficulty, 'ok' as tag_status from papers
""")
def q_tagging(t: Tables) -> DataFrame:
    """Batches of ten through the offline provider."""
    items = papers(t).select("paper_id", F.col("n").alias("question_number"), F.col("stem").alias("question_text"), "options")
    return tagged(items, OfflineProvider(), ["paper_id", "question_number"]).select("paper_id", F.col("question_number").cast("long").alias("question_number"), "subject", "difficulty", "tag_status")


@query(r"""
select doc_id, '[M L^-2 T^-1] ' || doc_id || ' [x^-3] - 2' as formula from documents
""")
def q_dimensional_formulas(t: Tables) -> DataFrame:
    """Rewrites inside brackets only."""
    return t.documents.select("doc_id", textnorm.dimensional_formulas(F.format_string("[M L − 2 T - 1] %d [x – 3] - 2", "doc_id")).alias("formula"))


@query("""
with m as (select doc_id, '# H ' || doc_id || chr(10) || '$x$ and $$y+' || doc_id || '$$' || chr(10) || '**Q1** z' as t from documents)
select doc_id, 1::bigint as headings, 6::bigint as dollars, 1::bigint as questions, 0::bigint as garbled from m
""")
def q_markdown_quality(t: Tables) -> DataFrame:
    """A14."""
    q = stats.markdown_quality(F.format_string("# H %d\n$x$ and $$y+%d$$\n**Q1** z", "doc_id", "doc_id"))
    return t.documents.select("doc_id", q.headings.cast("long").alias("headings"), q.dollars.cast("long").alias("dollars"), q.questions.cast("long").alias("questions"), q.garbled.cast("long").alias("garbled"))


@query("select event_type, count(*) as n, round(sum(value), 4) as total from events group by 1")
def q_stream_resume(t: Tables) -> DataFrame:
    """A file stream processed to its end in batches, from a checkpoint; equal to the batch result."""
    from ..streaming.resume import file_stream, resume

    root = f"{shared_folder(t.spark)}/stream-{uuid.uuid4().hex[:12]}"
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    t.events.repartition(4).write.parquet(f"{root}/in")
    query_ = resume(file_stream(t.spark, f"{root}/in", schema, 1), lambda b: b.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")), f"{root}/out", f"{root}/state")
    query_.awaitTermination()
    done = t.spark.read.parquet(f"{root}/out")
    return done.groupBy("event_type").agg(F.sum("n").alias("n"), F.round(F.sum("total"), 4).alias("total"))


@query("""
select time_bucket(interval '1 day', ts) as start, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2
""")
def q_tumbling_windows(t: Tables) -> DataFrame:
    """Event-time windows (an extension: the reference has no streams)."""
    w = F.window(F.col("ts"), "1 day")
    return t.events.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


@query("""
with g as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts, event_id) < interval '30 minutes' then 0 else 1 end as new, event_id from events),
s as (select user_id, ts, sum(new) over (partition by user_id order by ts, event_id rows unbounded preceding) as sid from g)
select user_id, min(ts) as start, count(*) as n from s group by user_id, sid
""")
def q_sessions(t: Tables) -> DataFrame:
    """Session windows by user (an extension)."""
    s = F.session_window("ts", "30 minutes")
    return t.events.groupBy(s.alias("s"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("s.start").alias("start"), "n")


@query("""
select round(coalesce(avg(l_discount), 0), 6) as overall, (select round(coalesce(avg(l_discount), 0), 6) from lineitem where l_linenumber < 0) as nothing from lineitem
""")
def q_average_confidence(t: Tables) -> DataFrame:
    """A7."""
    items = t.lineitem.select("l_linenumber", F.col("l_discount").alias("extraction_confidence"))
    none = stats.average_confidence(items.where("l_linenumber < 0")).first()["overall_confidence"]
    return stats.average_confidence(items).select(F.round("overall_confidence", 6).alias("overall"), F.round(F.lit(none), 6).alias("nothing"))


@query("""
select (p_partkey % 5)::bigint as question_number, p_partkey as id, case when p_partkey % 3 = 0 then -1 else (p_partkey % 6)::int end as correct_index,
  p_partkey % 3 <> 0 and p_partkey % 4 <> 0 as clean, p_partkey % 2 = 0 as complex from part
""")
def q_flagged_dataset(t: Tables) -> DataFrame:
    """F9-F11."""
    k = F.col("p_partkey")
    items = t.part.select(k.alias("id"), (k % 5).alias("question_number"), F.when(k % 2 == 0, "the value of cos is given").otherwise("plain words of some length").alias("question_text"),
                          F.when(k % 4 == 0, F.lit(["a", "b", "", "d"])).otherwise(F.lit(["a", "b", "c", "d"])).alias("options"), F.when(k % 3 == 0, F.lit(None)).otherwise((k % 6).cast("string")).alias("answer_raw"))
    out = filters.flagged_dataset(items)
    return out.select("question_number", "id", F.coalesce("correct_index", F.lit(-1)).alias("correct_index"), F.col("clean_textual").alias("clean"), F.col("complex_math").alias("complex"))
