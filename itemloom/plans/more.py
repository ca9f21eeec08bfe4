"""Queries for the remaining operators: formulas, options, contracts, overrides, providers, files."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import chemistry, latex, names, prompts
from ..operators import answers, classify, enrich, filters, retrieval, sampling, segment, stats
from ..operators.enrich import OfflineProvider
from ..sources import files, sinks
from ..shared import shared_folder
from .registry import PAPERS, Tables, paper_spans, papers, query

PROVIDER = OfflineProvider()


def items_of(t: Tables) -> DataFrame:
    """Constructed papers in the clean record's shape."""
    return papers(t).select("paper_id", F.col("n").alias("question_number"), F.col("stem").alias("question_text"), "options", F.lit("mcq").alias("question_type"), F.col("answer").alias("answer_raw"), "event_id", "event_type")


@query(r"""
select doc_id, '$a' || doc_id || '$' as first_formula, case doc_id % 3 when 0 then 'x $y$' when 1 then 'side $3 \times 4$' end as as_latex, 'b|a' || doc_id || '|b' as formulas, 'a' || doc_id as inline_only
from documents
""")
def q_latex_extract(t: Tables) -> DataFrame:
    """N17-N20."""
    text = F.format_string("so $a%d$ and $$b$$", "doc_id")
    k = F.col("doc_id") % 3
    plain = F.when(k == 0, "x $y$").when(k == 1, "side 3x4").otherwise("no maths")
    apart = F.filter(latex.formulas(text, True), lambda x: x != "b")
    return t.documents.select("doc_id", latex.first_formula(text).alias("first_formula"), latex.to_latex(plain).alias("as_latex"), F.array_join(latex.formulas(text), "|").alias("formulas"), F.array_join(apart, "|").alias("inline_only"))


@query("select doc_id, 'Head ' || doc_id as headers, 3::bigint as n_sections, 'a b' as clean from documents")
def q_markdown_structure(t: Tables) -> DataFrame:
    """N21, N22."""
    s = latex.markdown_structure(F.format_string("# Head %d\nintro\nQ1. one\nQ2. two", "doc_id"))
    return t.documents.select("doc_id", F.array_join(s.headers, "|").alias("headers"), F.size(s.sections).cast("long").alias("n_sections"), latex.clean_latex(F.lit(" a \n  b ")).alias("clean"))


@query("""
select page_id, 'Main ' || (2020 + page_id % 6) as exam_name, lpad((page_id % 28 + 1)::varchar, 2, '0') || ' Apr Shift 2' as shift, lpad((page_id % 28 + 1)::varchar, 2, '0') || ' Apr Shift 2' as info from pages
""")
def q_exam_names(t: Tables) -> DataFrame:
    """N14, N15."""
    name = F.concat(F.lit("JEE Main "), (F.lit(2020) + F.col("page_id") % 6).cast("string"), F.lit(" "), F.lpad((F.col("page_id") % 28 + 1).cast("string"), 2, "0"), F.lit(" Apr Shift 2"))
    m = names.exam_and_shift(name)
    return t.pages.select("page_id", m.exam_name.alias("exam_name"), m.exam_date_shift.alias("shift"), names.exam_info(F.regexp_replace(name, r"^JEE Main \d{4} ", "")).alias("info"))


@query("""
select doc_id, case doc_id % 4 when 0 then '2' when 1 then '3' when 2 then '1' else 'orig' end as answer, case doc_id % 4 when 0 then 'B' when 1 then 'C' else 'A' end as letter,
  case doc_id % 5 when 0 then 'structure' when 1 then 'reaction' when 2 then 'graph' when 3 then 'apparatus' else 'general' end as diagram
from documents
""")
def q_model_answers(t: Tables) -> DataFrame:
    """N30, N33, N38."""
    k, m = F.col("doc_id") % 4, F.col("doc_id") % 5
    given = F.when(k == 0, "b").when(k == 1, "3").when(k == 2, "Apple").otherwise("zzz")
    text = F.when(k == 0, "Answer: B").when(k == 1, "so (C) it is").otherwise("nothing")
    name = F.when(m == 0, "Organic_1.png").when(m == 1, "pathway.png").when(m == 2, "Plot2.png").when(m == 3, "SETUP.png").otherwise("x.png")
    return t.documents.select("doc_id", prompts.model_answer(given, F.lit(["an apple", "pear", "plum", "fig"]), F.lit("mcq"), F.lit("orig")).alias("answer"), prompts.letter_answer(text).alias("letter"), chemistry.diagram_kind(name).alias("diagram"))


@query(f"with {PAPERS} select paper_id, n::bigint as question_number, '1) ' || o1 || chr(10) || '2) ' || o2 || chr(10) || '3) ' || o3 || chr(10) || '4) ' || o4 as lines, answer || ') ' || case answer when '1' then o1 when '2' then o2 when '3' then o3 else o4 end as correct from papers")
def q_prompt_lines(t: Tables) -> DataFrame:
    """N28."""
    return papers(t).select("paper_id", F.col("n").cast("long").alias("question_number"), prompts.option_lines("options").alias("lines"), prompts.answer_line("options", F.col("answer").cast("int")).alias("correct"))


@query(f"with {PAPERS} select paper_id, n::bigint as question_number, stem as question_text, o1 || '|' || o2 || '|' || o3 || '|' || o4 as options, answer_letter as correct_answer from (select *, substr('ABCD', answer::int, 1) as answer_letter from papers)")
def q_prefix_items(t: Tables) -> DataFrame:
    """P5, P6: 'Qn. stem' and '(i) option' spans, an answer line closes an item."""
    letter = F.element_at(F.lit(list("ABCD")), F.col("answer").cast("int"))
    texts = F.array(F.format_string("Q%d. %s", "n", "stem"), *[F.concat(F.lit(f"({i + 1}) "), F.col("options")[i]) for i in range(4)], F.concat(F.lit("Answer: "), letter))
    spans = papers(t).select("paper_id", "n", F.posexplode(texts).alias("i", "text")).withColumn("pos", F.col("n") * 10 + F.col("i"))
    out = segment.prefix_items(spans)
    return out.select("paper_id", F.col("question_number").cast("long").alias("question_number"), "question_text", F.array_join(F.transform("options", lambda o: F.regexp_replace(o.text, r"^\(\d\) ", "")), "|").alias("options"), "correct_answer")


@query("select doc_id, 2::bigint as n_sections, 'A:p ' || doc_id || ',B:q' as options, 'Which?' as stem, 'a b|c d|e|f' as chunks from documents")
def q_loose_splits(t: Tables) -> DataFrame:
    """P3, P10, P11."""
    parts = segment.split_by_number(F.lit("Q1. one\n2. two"))
    opts = segment.lettered_options(F.format_string("(A) p %d (B) q", "doc_id"))
    four = segment.four_chunks(F.lit("Which? a b c d e f"))
    return t.documents.select("doc_id", F.size(parts).cast("long").alias("n_sections"), F.array_join(F.transform(opts, lambda o: F.concat(o.id, F.lit(":"), o.text)), ",").alias("options"), four.stem.alias("stem"), F.array_join(four.options, "|").alias("chunks"))


@query("select doc_id, 'plain ' || doc_id || chr(10) || 'nested' as combined from documents")
def q_polymorphic_text(t: Tables) -> DataFrame:
    """Blocks whose text is a string or a struct."""
    blocks = F.format_string('[{"text":"plain %d"},{"text":{"text":"nested"}},{"page":1}]', "doc_id")
    return t.documents.select("doc_id", answers.combined_text(blocks).alias("combined"))


@query(f"with {PAPERS} select paper_id, n::bigint as question_number, case when n % 3 = 0 then 'new' else answer end as correct_answer, n % 3 = 0 as mapped from papers")
def q_answer_override(t: Tables) -> DataFrame:
    """J4."""
    p = items_of(t).withColumnRenamed("answer_raw", "correct_answer")
    new = p.where("question_number % 3 = 0").select("paper_id", "question_number", F.lit("new").alias("answer"))
    return answers.overridden(p, new).select("paper_id", F.col("question_number").cast("long").alias("question_number"), "correct_answer", "mapped")


@query(f"""
with {PAPERS} select paper_id, n::bigint as question_number, case when n % 2 = 0 then 'Physics' else 'Unknown' end as subject, case when n % 2 = 0 then 'hard' else 'medium' end as difficulty from papers
""")
def q_tag_attach(t: Tables) -> DataFrame:
    """Tags with defaults."""
    p = items_of(t).select("paper_id", "question_number")
    tags = p.where("question_number % 2 = 0").select("*", F.lit("Physics").alias("subject"), F.lit("T").alias("topic"), F.lit("hard").alias("difficulty"))
    return answers.with_tags(p, tags, ["paper_id", "question_number"]).select("paper_id", F.col("question_number").cast("long").alias("question_number"), "subject", "difficulty")


@query(f"""
with {PAPERS}, m as (select distinct paper_id, n // 5 + 1 as page from papers where (n // 5) % 3 = 1)
select p.paper_id, p.n::bigint as question_number, case when m.page is null then '' else 'CCO,CN' end as smiles, 0.85::double as confidence from papers p left join m on p.paper_id = m.paper_id and p.n // 5 + 1 = m.page
""")
def q_combined_sources(t: Tables) -> DataFrame:
    """Items with molecules of their pages."""
    items = segment.marker_items(paper_spans(t))
    pages = papers(t).select("paper_id", "n", F.expr("cast(n div 5 + 1 as int)").alias("page"))
    mols = pages.where("(n div 5) % 3 = 1").select("paper_id", "page").distinct().select("*", F.lit("success").alias("status"), F.lit(["CCO", "CN"]).alias("smiles"))
    failed = mols.withColumn("status", F.lit("error"))
    none = mols.limit(0).select("paper_id", "page", F.lit("").alias("filename"))
    out = answers.combined(items, none, mols.unionByName(failed))
    return out.select("paper_id", F.col("question_number").cast("long").alias("question_number"), F.array_join("chemical_smiles", ",").alias("smiles"), F.col("extraction_confidence").cast("double").alias("confidence"))


@query("""
select doc_id, case doc_id % 4 when 0 then 'source is required' when 1 then 'n is not int' else '' end as errors from documents
""")
def q_contract_errors(t: Tables) -> DataFrame:
    """V5, V6."""
    k = F.col("doc_id") % 4
    rows = t.documents.select("doc_id", F.when(k == 0, F.lit(None)).otherwise(F.col("source")).alias("source"), F.when(k == 1, "x").otherwise("7").alias("n"))
    checked, _ = filters.quarantined(rows, {"source": "string", "n": "int"})
    return checked.select("doc_id", F.array_join("errors", ",").alias("errors"))


@query(f"""
with {PAPERS} select paper_id, bool_and(event_id % 97 <> 0) as valid, count(*) as n from papers group by 1
""")
def q_valid_answer_maps(t: Tables) -> DataFrame:
    """V7."""
    a = papers(t).select("paper_id", F.col("n").alias("question_number"), F.when(F.col("event_id") % 97 == 0, "x").otherwise(F.col("answer")).alias("answer"))
    return filters.valid_answer_maps(a).select("paper_id", "valid", "n")


@query("""
select p_partkey, case p_partkey % 4 when 0 then '' when 1 then 'Question: Unbalanced $ signs' when 2 then 'Not enough options' else 'Option: Unbalanced braces (missing })' end as error from part
""")
def q_item_errors(t: Tables) -> DataFrame:
    """V2."""
    k = F.col("p_partkey") % 4
    options = F.when(k == 2, F.lit(["a", "b"])).when(k == 3, F.lit(["a", "{", "c", "d"])).otherwise(F.lit(["a", "b", "c", "d"]))
    return t.part.select("p_partkey", latex.item_error(F.when(k == 1, "$x").otherwise("fine"), options, F.lit("mcq")).alias("error"))


@query("""
select count(*) as total, count(*) filter (where toxic = 0) as successful, count(*) filter (where toxic <> 0) as failed, round(100.0 * count(*) filter (where toxic = 0) / greatest(count(*), 1), 2) as success_rate, round(sum(doc_id % 5 * 0.5::double) / greatest(count(*), 1), 4) as average_duration from labels
""")
def q_batch_summary(t: Tables) -> DataFrame:
    """A8."""
    r = t.labels.select(F.when(F.col("toxic") == 0, "success").otherwise("error").alias("status"), (F.col("doc_id") % 5 * 0.5).alias("duration"))
    return stats.batch_summary(r)


@query("select o_orderpriority as value, count(*) as n from orders group by 1")
def q_histogram(t: Tables) -> DataFrame:
    """A9, A10."""
    return stats.histogram(t.orders.select(F.col("o_orderpriority").alias("value")), "value")


@query("select p_brand as subject, p_type as question_type, count(*) as available from part group by 1, 2")
def q_availability(t: Tables) -> DataFrame:
    """A11."""
    return stats.availability(t.part.select(F.col("p_brand").alias("subject"), F.col("p_type").alias("question_type")))


@query(f"""
with {PAPERS} select case length(stem) % 4 when 0 then 'change_numbers' when 1 then 'rephrase' when 2 then 'fix_incomplete' else 'discard' end as action, count(*) as n from papers group by 1
""")
def q_action_classes(t: Tables) -> DataFrame:
    """Actions by the offline provider."""
    out = enrich.classified(items_of(t), PROVIDER, ["paper_id", "question_number"])
    return stats.histogram(out, "action")


@query(f"""
with {PAPERS}, a as (select paper_id, n, length(stem) % 4 as k from papers)
select case when k = 3 then 'rephrase' when k = 0 then 'change_numbers' when k = 1 then 'rephrase' else 'fix_incomplete' end as action, 'transformed' as transform_status, count(*) as n from a group by 1, 2
""")
def q_transform_items(t: Tables) -> DataFrame:
    """Classify, replace, rewrite, validate; nothing to replace from, so discarded items stay as 'rephrase'."""
    items = items_of(t)
    out = enrich.transform_questions(items, items, PROVIDER, ["paper_id", "question_number"], ["paper_id"])
    return out.groupBy("action", "transform_status").agg(F.count("*").alias("n"))


@query(f"with {PAPERS} select paper_id, count(*) as n, count(*) filter (where true) as annotated from papers where n % 2 = 0 group by 1")
def q_annotations(t: Tables) -> DataFrame:
    """Items without an annotation get one."""
    listed = F.transform("options", lambda x, i: F.struct((i + 1).cast("string").alias("id"), x.alias("text"), F.lit(None).cast("string").alias("latex")))
    items = items_of(t).withColumn("options", listed).withColumn("ml_annotations", F.struct(F.when(F.col("question_number") % 2 == 1, "easy").alias("difficulty")))
    out = enrich.annotated(items, PROVIDER)
    return out.groupBy("paper_id").agg(F.count("*").alias("n"), F.count("annotation").alias("annotated"))


def variations_of(t: Tables) -> DataFrame:
    """The whole context of each conversation to a new item (the offline provider echoes JSON)."""
    ctx = retrieval.context(t.conversations, "text", ["conv_id"], ["turn"], 3)
    ctx = ctx.withColumn("context", F.to_json(F.struct(F.col("context").alias("question_text"), F.array(F.lit("a")).alias("options"), F.lit("1").alias("correct_answer"))))
    return enrich.variation(ctx, PROVIDER)


@query("""
select conv_id, true as ok, md5(string_agg(text, chr(10) || '---' || chr(10) order by turn)) as h
from (select *, row_number() over (partition by conv_id order by turn) as nth from conversations) where nth <= 3 group by 1
""")
def q_variation_texts(t: Tables) -> DataFrame:
    """Digests of the new items' texts."""
    return variations_of(t).select("conv_id", "ok", F.md5("item.question_text").alias("h"))


@query()
def q_hashed_embeddings_all(t: Tables) -> DataFrame:
    """E11 on every whole text (xxhash64 has no SQL here); empty and null texts are embedded by their topic alone."""
    return t.documents.select("doc_id", retrieval.hashed_embedding(retrieval.store_text("source", "text"), 16).alias("embedding"))


@query("""
with b as (select p_partkey as id, p_size::double as x0, p_size + 5.0 as x1, (p_partkey % 10)::double as y0, p_partkey % 10 + 3.0 as y1 from part)
select a.id, count(*) - 1 as n from b a join b on not (a.x1 < b.x0 or b.x1 < a.x0 or a.y1 < b.y0 or b.y1 < a.y0) group by 1
""")
def q_box_overlap_counts(t: Tables) -> DataFrame:
    """N36 on every box of the table: how many others each one meets."""
    k = F.col("p_partkey")
    box = F.struct(F.col("p_size").cast("double").alias("x0"), (F.col("p_size") + 5.0).alias("x1"), (k % 10).cast("double").alias("y0"), (k % 10 + 3.0).alias("y1"))
    return retrieval.overlap_counts(t.part.select(k.alias("id"), box.alias("box")))


@query("select doc_id % 100 as paper_id, count(*) as n, sum(n_chars)::bigint as chars from documents group by 1")
def q_jsonl_round_trip(t: Tables) -> DataFrame:
    """Written as JSON lines and read with an explicit schema."""
    path = f"{shared_folder(t.spark)}/jsonl-{uuid.uuid4().hex[:12]}"
    sinks.to_jsonl(t.documents.select((F.col("doc_id") % 100).alias("paper_id"), "text", "n_chars"), path)
    back = files.jsonl(t.spark, path, "paper_id bigint, text string, n_chars bigint", {})
    return back.groupBy("paper_id").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query(f"with {PAPERS} select paper_id, max(n // 5 + 1)::bigint as total_pages, count(distinct n // 5 + 1) as n_sizes from papers group by 1")
def q_page_sizes(t: Tables) -> DataFrame:
    """S4."""
    pages = papers(t).select("paper_id", F.expr("cast(n div 5 + 1 as int)").alias("page")).distinct().select("*", F.lit(595.0).alias("width"), F.lit(842.0).alias("height"))
    return files.page_sizes(pages).select("paper_id", F.col("total_pages").cast("long").alias("total_pages"), F.size("page_dimensions").cast("long").alias("n_sizes"))


@query("""
select doc_id, case doc_id % 3 when 0 then 'MCQ' when 1 then 'MCQ' else 'MCQ' end as kind, '{"a":"x"}' as sparse from documents
""")
def q_sparse_records(t: Tables) -> DataFrame:
    """JSON without nulls and empty arrays."""
    record = F.struct(F.lit("x").alias("a"), F.lit(None).cast("string").alias("b"), F.array().cast("array<string>").alias("c"))
    rows = t.documents.select("doc_id", record.alias("r"))
    return rows.select("doc_id", classify.type_constant().alias("kind"), prompts.without_empty(F.col("r"), {"a": "value", "b": "value", "c": "array"}).alias("sparse"))


@query("select vec_id, label from embeddings where vec_id % 2 = 0")
def q_zip_and_lookup_all(t: Tables) -> DataFrame:
    """J12, J13 on every vector id."""
    ids = t.embeddings.select("vec_id")
    even = ids.where("vec_id % 2 = 0").withColumn("x", F.lit(1))
    return sampling.looked_up(sampling.zipped(ids, even, ["vec_id"]), t.embeddings).select("vec_id", "label")
