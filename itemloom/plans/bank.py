"""Queries over documents: cleaning, classification, statistics, sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import names, prompts, textnorm
from ..operators import answers, classify, filters, ordinal, sampling, stats
from .registry import WHITE, Tables, query

# Keyword tables that occur in the test documents (fixed values for these queries).
WORDS_A = ("the", "tion", "idiot", "scum")
WORDS_B = ("der", "ung", "que")
WORDS_C = ("aire", "eux", "dans")


def regex_of(words: tuple[str, ...]) -> str:
    return "|".join(words)


def count_sql(words: tuple[str, ...], col: str = "text") -> str:
    return " + ".join(f"(contains(lower({col}), '{w}'))::int" for w in words)


@query(f"""
with d as (
  select source, regexp_replace(regexp_replace(text, '[{WHITE}]{{2,}}', ' ', 'g'), '^[{WHITE}]+|[{WHITE}]+$', '', 'g') as t, doc_id from documents),
j as (
  select d.source, d.t, l.quality,
         case when {count_sql(WORDS_A, 't')} > {count_sql(WORDS_B, 't')} then 'A' when {count_sql(WORDS_B, 't')} > 0 then 'B' else 'C' end as subject
  from d left join labels l using (doc_id))
select source, count(*) as n, count(quality) as with_answer,
       coalesce(round(100.0 * count(quality) / nullif(count(*), 0), 1), 0) as coverage,
       count(*) filter (where subject = 'A') as n_a, count(*) filter (where subject = 'B') as n_b, count(*) filter (where subject = 'C') as n_c,
       sum(length(t))::bigint as chars
from j group by source
""")
def q_bank_statistics(t: Tables) -> DataFrame:
    """Flagship: normalise, classify, attach labels, sum up by source."""
    d = t.documents.select("doc_id", "source", textnorm.collapse_spaces("text").alias("t"))
    d = d.withColumn("subject", classify.by_score("t", WORDS_A, WORDS_B, ("A", "B", "C"))).join(t.labels.select("doc_id", "quality"), "doc_id", "left")
    n = [F.count_if(F.col("subject") == s).alias(f"n_{s.lower()}") for s in "ABC"]
    return d.groupBy("source").agg(F.count("*").alias("n"), F.count("quality").alias("with_answer"), stats.rate(F.count("quality"), F.count("*"), 1).alias("coverage"), *n, F.sum(F.length("t").cast("long")).alias("chars"))


PHRASE = " 0 . 30 m 10 -2 39.9 % 2 9 m 5N 2 x 10 3 sin 30 m s -2  end"


#: White space and line ends of the Spark side, for SQL.
BLANK, INLINE = r"[ \t\n\x0b\f\r]", r"[^\n\r\x{85}\x{2028}\x{2029}]"


@query(rf"""
with s as (select doc_id, translate(text || ' ' || doc_id || '{PHRASE}', '−𝑔𝑇𝑅𝜃𝜋𝐿𝑀𝑡', '-gTRθπLMt') as t from documents),
a as (select doc_id, regexp_replace(t, '(\d){BLANK}*\.{BLANK}*(\d)', '\1.\2', 'g') as t from s),
b as (select doc_id, regexp_replace(t, '(\d(?:\.\d+)?){BLANK}*([A-Za-z](?:[A-Za-z])?)\b', '\1 \2', 'g') as t from a),
c as (select doc_id, regexp_replace(t, '\b([1-9]){BLANK}+([1-9]){BLANK}+(m|R|N|J|kg|L|C|V|A|T|H|F)\b', '\1/\2 \3', 'g') as t from b),
c2 as (select doc_id, regexp_replace(t, '\b([1-9]\d?){BLANK}+([1-9]\d?)({BLANK}*[,;:)])', '\1/\2\3', 'g') as t from c),
d as (select doc_id, regexp_replace(t, '(?i)(\d+(?:\.\d+)?){BLANK}*[x×]{BLANK}*10{BLANK}*(?:\^{BLANK}*)?(\d+)', '\1 x 10^\2', 'g') as t from c2),
e as (select doc_id, regexp_replace(t, '10{BLANK}*[-−]{BLANK}*(\d+)', '10^-\1', 'g') as t from d),
f as (select doc_id, regexp_replace(t, '(m|s|kg|N|J|W|Hz|Pa|C|V|F|Ω|ohm){BLANK}+[-−]{BLANK}*(\d+)', '\1^-\2', 'g') as t from e),
p as (select doc_id, string_split_regex(t, '\[{INLINE}*?\]') as outside, list_transform(regexp_extract_all(t, '\[{INLINE}*?\]'), lambda x: regexp_replace(x, '{BLANK}+[−–-]{BLANK}+(\d+)', '^-\1', 'g')) as inside from f),
g as (select doc_id, array_to_string(list_transform(list_zip(outside, list_append(inside, '')), lambda x: x[1] || x[2]), '') as t from p),
h as (select doc_id, regexp_replace(t, '\b(sin|cos|tan|cot|sec|cosec){BLANK}+([-−]?\d+(?:\.\d+)?)', '\1(\2)', 'g') as t from g),
i as (select doc_id, regexp_replace(t, '(\d(?:\.\d+)?){BLANK}*%', '\1%', 'g') as t from h),
j as (select doc_id, regexp_replace(regexp_replace(t, '{BLANK}{{2,}}', ' ', 'g'), '^{BLANK}+|{BLANK}+$', '', 'g') as t from i)
select doc_id, length(t) as chars, md5(t) as h from j
""")
def q_normalize_documents(t: Tables) -> DataFrame:
    """N1-N10 on each whole text with the constructed phrase after it; a null text stays null."""
    text = F.concat("text", F.lit(" "), F.col("doc_id").cast("string"), F.lit(PHRASE))
    rows = t.documents.select("doc_id", textnorm.normalise(text, unicode=False).alias("normal"))
    return rows.select("doc_id", F.length("normal").cast("long").alias("chars"), F.md5("normal").alias("h"))


@query(rf"""
select doc_id, md5(regexp_replace(case doc_id % 5 when 0 then text || '  MathonGo x' when 1 then text || ' see HTTPS://a.b' when 2 then left(text, 9) || '  jee main 2024 b' || text else text end,
       '(?is)[{WHITE}]*(?:JEE Main 2024|JEE Main 2025|MathonGo|https://|www\.).*', '')) as h
from documents
""")
def q_strip_junk(t: Tables) -> DataFrame:
    """Text cut at the earliest marker."""
    k = F.col("doc_id") % 5
    marked = F.when(k == 0, F.concat("text", F.lit("  MathonGo x"))).when(k == 1, F.concat("text", F.lit(" see HTTPS://a.b"))).when(k == 2, F.concat(F.left("text", F.lit(9)), F.lit("  jee main 2024 b"), "text")).otherwise(F.col("text"))
    return t.documents.select("doc_id", F.md5(textnorm.strip_junk(marked)).alias("h"))


@query(r"""
with n as (select page_id, 'JEE Main ' || (2020 + page_id % 6) || ' (' || lpad((page_id % 28 + 1)::varchar, 2, '0') || ' Feb Shift ' || (page_id % 2 + 1) || ') ' || url as name from pages)
select page_id, regexp_extract(name, 'JEE Main (\d{4})', 1)::bigint as year, regexp_extract(name, '\((\d{2} \w+) Shift (\d)\)', 1) as date,
       regexp_extract(name, '\((\d{2} \w+) Shift (\d)\)', 2)::bigint as shift,
       left(regexp_replace(replace(replace(replace(name, ' ', '_'), '(', ''), ')', ''), '[^a-zA-Z0-9_-]', '', 'g'), 30) || '_q' || page_id as qid
from n
""")
def q_name_metadata(t: Tables) -> DataFrame:
    """N13, N16."""
    p = F.col("page_id")
    name = F.concat(F.lit("JEE Main "), (F.lit(2020) + p % 6).cast("string"), F.lit(" ("), F.lpad((p % 28 + 1).cast("string"), 2, "0"), F.lit(" Feb Shift "), (p % 2 + 1).cast("string"), F.lit(") "), "url")
    m = names.paper_metadata(name)
    return t.pages.select("page_id", m.year.cast("long").alias("year"), m.date.alias("date"), m.shift.cast("long").alias("shift"), names.question_id(name, "page_id").alias("qid"))


@query(f"""
select doc_id, case when regexp_matches(lower(text), '{regex_of(WORDS_A)}') then 'A' when regexp_matches(lower(text), '{regex_of(WORDS_B)}') then 'B' else 'C' end as subject from documents
""")
def q_subject_priority(t: Tables) -> DataFrame:
    """C1."""
    return t.documents.select("doc_id", classify.by_priority("text", (("A", WORDS_A), ("B", WORDS_B)), "C").alias("subject"))


@query(f"""
select doc_id, case when {count_sql(WORDS_A)} > {count_sql(WORDS_B)} then 'A' when {count_sql(WORDS_B)} > 0 then 'B' else 'C' end as subject from documents
""")
def q_subject_score(t: Tables) -> DataFrame:
    """C2."""
    return t.documents.select("doc_id", classify.by_score("text", WORDS_A, WORDS_B, ("A", "B", "C")).alias("subject"))


@query(f"""
with s as (select doc_id, {count_sql(WORDS_A)} as a, {count_sql(WORDS_B)} as b, {count_sql(WORDS_C)} as c from documents)
select doc_id, case when a >= b and a >= c then 'A' when b >= c then 'B' else 'C' end as subject from s
""")
def q_subject_argmax(t: Tables) -> DataFrame:
    """C3."""
    return t.documents.select("doc_id", classify.by_argmax("text", {"A": WORDS_A, "B": WORDS_B, "C": WORDS_C}).alias("subject"))


@query("""
select doc_id,
  case when contains(t, 'column') and contains(t, 'match') then 'Match the Column' when contains(t, 'assert') or contains(t, 'reason') then 'Assertion-Reason'
       when contains(t, 'value') or contains(t, 'find') or contains(t, 'calculate') then 'Numerical' else 'MCQ' end as by_text,
  case when doc_id % 5 = 4 then 'MCQ' when doc_id % 5 = 0 then 'Numerical' when contains(t, 'match') then 'Match the Column'
       when contains(t, 'assertion') or contains(t, 'reason') then 'Assertion-Reason' else 'MCQ' end as by_options
from (select doc_id, lower(case doc_id % 4 when 0 then 'Match the column ' when 1 then 'Assertion: ' when 2 then 'Find ' else '' end || text) as t from documents)
""")
def q_type_rules(t: Tables) -> DataFrame:
    """C4, C5."""
    k = F.col("doc_id") % 4
    text = F.concat(F.when(k == 0, "Match the column ").when(k == 1, "Assertion: ").when(k == 2, "Find ").otherwise(""), F.col("text"))
    return t.documents.select("doc_id", classify.type_by_text(text).alias("by_text"), classify.type_by_options(text, F.col("doc_id") % 5).alias("by_options"))


@query("""
select doc_id, regexp_matches(lower(t), 'in the figure|in figure|in the following figure|in the diagram|shown in figure|shown in the figure|circuit diagram|given circuit|the circuit shown|as shown|figure shows|diagram shows') as needs_figure,
       contains(t, '_____') as is_integer
from (select doc_id, text || case doc_id % 4 when 0 then ' As Shown here' when 1 then ' is _____' else '' end as t from documents)
""")
def q_figure_filter(t: Tables) -> DataFrame:
    """F1-F4."""
    k = F.col("doc_id") % 4
    text = F.concat("text", F.when(k == 0, " As Shown here").when(k == 1, " is _____").otherwise(""))
    return t.documents.select("doc_id", filters.needs_figure(text).alias("needs_figure"), filters.is_integer_type(text).alias("is_integer"))


@query("""
with d as (select doc_id, doc_id % 7 as k, doc_id % 3 as o, doc_id % 6 as a from documents),
j as (select case when k = 0 then 'figure' when k = 1 then (case when a = 5 then 'integer_without_answer' else 'integer' end)
      when o = 0 then 'bad_options' when a = 5 then 'mcq_without_answer' when a = 0 then 'answer_out_of_range' else 'mcq' end as disposition from d)
select disposition, count(*) as n from j group by 1
""")
def q_quality_disposition(t: Tables) -> DataFrame:
    """Why constructed items are kept or dropped."""
    k, o, a = F.col("doc_id") % 7, F.col("doc_id") % 3, F.col("doc_id") % 6
    items = t.documents.select(
        F.when(k == 0, "Given circuit below").when(k == 1, "Fill _____ in").otherwise("Plain stem").alias("question_text"),
        F.when(o == 0, F.lit(["a", " ", "c", "d"])).otherwise(F.lit(["a", "b", "c", "d"])).alias("options"),
        F.when(a == 5, F.lit(None)).otherwise(a.cast("string")).alias("answer_raw"),
    )
    return filters.clean_items(items).groupBy("disposition").agg(F.count("*").alias("n"))


@query("""
select dimension, value, count(*) as n from (
  select 'lang' as dimension, lang as value from documents union all select 'source', source from documents union all select 'total', '' from documents) group by 1, 2
""")
def q_stats_grouping_sets(t: Tables) -> DataFrame:
    """A1, A10: one pass over the documents."""
    return stats.counts_by(t.documents.select("lang", "source"), "lang", "source")


@query("""
with s as (select d.source, case when l.doc_id is null then 'extracted_only' when l.quality = 1 then 'verified' else 'mismatch' end as status from documents d left join labels l using (doc_id))
select source, count(*) filter (where status = 'verified') as verified, count(*) filter (where status = 'mismatch') as mismatch,
       count(*) filter (where status = 'extracted_only') as extracted_only, count(*) as total, coalesce(round(100.0 * count(*) filter (where status = 'verified') / nullif(count(*), 0), 2), 0) as rate
from s group by source
""")
def q_stats_safe_ratio(t: Tables) -> DataFrame:
    """A4, A5: three disjoint statuses."""
    d = t.documents.select("doc_id", "source").join(t.labels, "doc_id", "left")
    d = d.withColumn("status", F.when(F.col("quality").isNull(), "extracted_only").when(F.col("quality") == 1, "verified").otherwise("mismatch"))
    return stats.verification(d, "source")


@query("""
select o_orderstatus as paper_id, count(*) filter (where k = 'mcq') as mcq, count(*) filter (where k = 'integer') as integer, count(*) as total, grouping(o_orderstatus)::int as is_total
from (select o_orderstatus, case when o_orderpriority like '%URGENT%' then 'integer' else 'mcq' end as k from orders) group by rollup (o_orderstatus)
""")
def q_stats_rollup(t: Tables) -> DataFrame:
    """A3."""
    items = t.orders.select(F.col("o_orderstatus").alias("paper_id"), F.when(F.col("o_orderpriority").contains("URGENT"), "integer").otherwise("mcq").alias("question_type"))
    return stats.dataset_stats(items).withColumn("is_total", F.col("is_total").cast("int"))


@query("""
with d as (select doc_id, lang as subject, case when n_chars < 1500 then 'integer' else 'mcq' end as question_type, case doc_id % 3 when 0 then 'easy' when 1 then 'medium' else 'hard' end as difficulty from documents),
q(question_type, difficulty, quota) as (values ('mcq', 'easy', 4), ('mcq', 'medium', 12), ('mcq', 'hard', 4), ('integer', 'easy', 2), ('integer', 'medium', 6), ('integer', 'hard', 2)),
r as (select d.*, quota, row_number() over (partition by subject, question_type, difficulty order by md5('7|' || doc_id), doc_id) as nth from d join q using (question_type, difficulty))
select doc_id, subject, question_type, difficulty from r where nth <= quota
""")
def q_stratified_sample(t: Tables) -> DataFrame:
    """L1, L2."""
    k = F.col("doc_id") % 3
    items = t.documents.select("doc_id", F.col("lang").alias("subject"), F.when(F.col("n_chars") < 1500, "integer").otherwise("mcq").alias("question_type"), F.when(k == 0, "easy").when(k == 1, "medium").otherwise("hard").alias("difficulty"))
    return sampling.quota_sample(items, sampling.quotas(t.spark, "medium"), 7, ["doc_id"]).select("doc_id", "subject", "question_type", "difficulty")


@query("""
select o_orderkey as id, year(o_orderdate)::int as year, case when o_orderpriority = '1-URGENT' then 'mcq' else 'integer' end as question_type,
       case when lower(o_orderstatus) in ('f') then 'easy' else 'medium' end as difficulty
from orders where year(o_orderdate) in (1995, 1996) and (contains(lower(o_orderpriority), 'urgent') or contains(lower(o_orderpriority), 'low'))
""")
def q_topic_year_filter(t: Tables) -> DataFrame:
    """F12."""
    items = t.orders.select(F.col("o_orderkey").alias("id"), F.year("o_orderdate").alias("year"), F.col("o_orderpriority").alias("topic"), F.lit("Physics").alias("subject"),
                            F.when(F.col("o_orderpriority") == "1-URGENT", "mcq").otherwise("numeric").alias("question_type"), F.when(F.col("o_orderstatus") == "F", "Easy").otherwise("?").alias("difficulty"))
    return filters.bucketed(items, [1995, 1996], ["Urgent", "LOW"]).select("id", "year", "question_type", "difficulty")


@query("select doc_id, source from documents d where not exists (select 1 from labels l where l.doc_id = d.doc_id)")
def q_resume_antijoin(t: Tables) -> DataFrame:
    """J7, J8."""
    return sampling.not_done(t.documents.select("doc_id", "source"), t.labels, ["doc_id"])


@query("""
with sel as (select doc_id, lang, case when doc_id % 6 = 0 then 'discard' else 'rephrase' end as action from documents where doc_id % 2 = 0),
gone as (select *, row_number() over (partition by lang order by md5('3d|' || doc_id), doc_id) as nth from sel where action = 'discard'),
spare as (select doc_id, lang, row_number() over (partition by lang order by md5('3p|' || doc_id), doc_id) as nth from documents where doc_id % 5 = 1 and doc_id % 2 = 1)
select doc_id, lang, false as replaced from sel where action <> 'discard'
union all select coalesce(s.doc_id, g.doc_id), g.lang, s.doc_id is not null from gone g left join spare s on g.lang = s.lang and g.nth = s.nth
""")
def q_pool_replacement(t: Tables) -> DataFrame:
    """J10, J11."""
    d = t.documents.select("doc_id", "lang")
    sel = d.where("doc_id % 2 = 0").withColumn("action", F.when(F.col("doc_id") % 6 == 0, "discard").otherwise("rephrase"))
    pool = d.where("doc_id % 5 = 1 or doc_id % 2 = 0")
    return sampling.replaced(sel, pool, 3, ["doc_id"], ["lang"]).select("doc_id", "lang", "replaced")


@query("""
with r as (select source, doc_id, (row_number() over (partition by source order by doc_id) - 1) as rn, left(text, 500) as t from documents)
select source, (rn // 10)::bigint as batch, count(*) as n, sum(length(t))::bigint as chars, min(doc_id) as first_id from r group by 1, 2
""")
def q_prompt_batches(t: Tables) -> DataFrame:
    """Items in batches of ten with bounded text."""
    placed = ordinal.ranked(t.documents, ["source"], F.expr("doc_id div 1024"), ["doc_id"], "rn")
    r = placed.select("source", "doc_id", F.expr("rn div 10").alias("batch"), prompts.prompt_row("text", F.array().cast("array<string>")).text.alias("t"))
    return r.groupBy("source", "batch").agg(F.count("*").alias("n"), F.sum(F.length("t").cast("long")).alias("chars"), F.min("doc_id").alias("first_id"))


@query("""
select source as source_file, count(*) as n, count(distinct text) as different from documents group by source
union all select 'benchmark', count(*), count(distinct text) from benchmark
""")
def q_union_papers(t: Tables) -> DataFrame:
    """U1, U2, U4."""
    both = sampling.union_all(t.documents.select(F.col("source").alias("source_file"), "text"), t.benchmark.select(F.lit("benchmark").alias("source_file"), "text"))
    return both.groupBy("source_file").agg(F.count("*").alias("n"), F.count_distinct(F.sha2("text", 256)).alias("different"))


@query("""
with d as (select d.doc_id, d.source, (doc_id % 4 + 1)::varchar as ans, case doc_id % 5 when 0 then null when 1 then '' when 2 then chr((65 + doc_id % 4)::int) when 3 then (doc_id % 4 + 1)::varchar else '9' end as raw from documents d),
m as (select *, case when raw is null or raw = '' then null when raw ~ '^[A-D]' then translate(raw, 'ABCD', '1234') else raw end as mapped from d)
select doc_id, coalesce(mapped, ans) as final_answer, case when mapped is null then 'extracted_only' when mapped = ans then 'verified' else 'mismatch' end as status,
       case when mapped is null then 0.7::double when mapped = ans then 0.95::double else 0.5::double end as confidence from m
""")
def q_answer_merge(t: Tables) -> DataFrame:
    """Extracted answers against a raw key with letters, gaps and errors."""
    d, k = F.col("doc_id"), F.col("doc_id") % 5
    items = t.documents.select(F.col("source").alias("source_file"), F.col("doc_id").alias("question_number"), (d % 4 + 1).cast("string").alias("correct_answer"))
    raw = t.documents.where(k != 0).select(F.col("source").alias("source_file"), F.col("doc_id").alias("question_number"), F.when(k == 1, "").when(k == 2, F.element_at(F.lit(list("ABCD")), (d % 4 + 1).cast("int"))).when(k == 3, (d % 4 + 1).cast("string")).otherwise("9").alias("raw_answer"))
    return answers.verified(items, raw).select(F.col("question_number").alias("doc_id"), "final_answer", "status", "confidence")


@query("select doc_id, lang, count(*) over (partition by lang) as in_lang from documents order by md5('5|' || doc_id), doc_id limit 50")
def q_uniform_sample(t: Tables) -> DataFrame:
    """L4: fifty rows without replacement."""
    n = t.documents.groupBy("lang").agg(F.count("*").alias("in_lang"))
    picked = sampling.sample_n(t.documents.select("doc_id", "lang"), 50, 5, "doc_id")
    return picked.join(n, "lang").select("doc_id", "lang", "in_lang")


@query("""
select case when l.doc_id is null then 'error' when l.toxic = 1 then 'warning' else 'success' end as status, count(*) as files, sum(d.n_chars)::bigint as questions
from documents d left join labels l using (doc_id) group by 1
""")
def q_status_counts(t: Tables) -> DataFrame:
    """A12."""
    d = t.documents.join(t.labels, "doc_id", "left").select(F.when(F.col("toxic").isNull(), "error").when(F.col("toxic") == 1, "warning").otherwise("success").alias("status"), F.col("n_chars").alias("total_questions"))
    return stats.status_counts(d)
