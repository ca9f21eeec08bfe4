"""Column rewrites against plain statements of their rules, and edge rows."""

import random
import re

import pytest
from pyspark.sql import functions as F

from itemloom.functions import chemistry, latex, names, prompts, textnorm
from itemloom.functions.rewrite import strip
from itemloom.operators import answers, classify, filters, segment

ALPHABET = list("0123456789 .%mNkgsinco[]()x^-−–,;:\t\n") + ["\u00a0", "sin", "cos", "10", "θ", "𝑔"]


@pytest.fixture(scope="module")
def noise():
    rng = random.Random(5)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 30))) for _ in range(400)] + [""]


def apply(spark, texts, column):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in df.withColumn("o", column(F.col("t"))).orderBy("i").select("o").collect()]


def in_brackets(text):
    return re.sub(r"\[(.*?)\]", lambda m: "[" + re.sub(r"\s+[−–-]\s+(\d+)", r"^-\1", m.group(1)) + "]", text)


@pytest.mark.parametrize(
    ("column", "rule"),
    [
        (textnorm.close_decimals, lambda t: re.sub(r"(\d)\s*\.\s*(\d)", r"\1.\2", t)),
        (textnorm.close_percents, lambda t: re.sub(r"(\d(?:\.\d+)?)\s*%", r"\1%", t)),
        (textnorm.space_units, lambda t: re.sub(r"(\d(?:\.\d+)?)\s*([A-Za-z](?:[A-Za-z])?)\b", r"\1 \2", t)),
        (textnorm.dimensional_formulas, in_brackets),
        (textnorm.collapse_spaces, lambda t: re.sub(r"\s{2,}", " ", t).strip()),
    ],
)
def test_rewrites_follow_their_rules(spark, noise, column, rule):
    assert apply(spark, noise, column) == [rule(t) for t in noise]


def test_normalise_examples(spark):
    got = apply(spark, ["0 . 30   m", "2 9 m", "10 -2", "sin -20", "39.9 %", None, "", "2 x 10 3 b c", "1 2"], textnorm.normalise)
    assert got == ["0.30 m", "2/9 m", "10^-2", "sin(-20)", "39.9%", None, "", "2 x 10^3 b c", "1/2"]


def test_junk_is_cut_at_the_earliest_marker(spark):
    assert apply(spark, ["a  mathongo b https://c", "x www.y", "plain", None], textnorm.strip_junk) == ["a", "x", "plain", None]


def test_names(spark):
    got = apply(spark, ["JEE Main 2024 (01 Feb Shift 1) x", "other"], names.paper_metadata)
    assert [(r.year, r.date, r.shift) for r in got] == [(2024, "01 Feb", 1), (0, "Unknown", 0)]


def test_latex_errors(spark):
    texts = ["$a$", "$a", "}{", "{", r"\mathbb{R}", "$a$ $b$ $c$ $d$ $e$", None, ""]
    got = apply(spark, texts, latex.latex_error)
    assert [bool(x) for x in got] == [False, True, True, True, True, True, False, False]


def test_unicode_to_latex(spark):
    got = apply(spark, ["α × 𝐴", r"$\frac{1}{2}$ and \frac{1}{2}", "10^-3", r"\u0041b", None], latex.fix_unicode)
    assert got[0] == r"$\alpha$ $\times$ $A$"
    assert got[1] == r"$\frac{1}{2}$ and $\frac{1}{2}$"
    assert got[2] == "$10^{-3}$"
    assert got[4] is None
    assert apply(spark, ["$a$ $b$ $c$", r"\u0041b", "x_max", None], latex.fix_latex) == ["$a b c$", "Ab", "x_{max}", ""]


def test_json_repair(spark):
    def both(c):
        return F.size(prompts.parse_answers(c, "struct<id:int,topic:string>", F.lit(1)))

    assert apply(spark, ['```json\n[{"id":1,"topic":"\\frac"}]\n```', '[{"id":1},{"id":2}]', "no"], both) == [1, 0, 0]


def test_answers_to_digits(spark):
    assert apply(spark, ["2", "B", "b) x", "9", "", None], prompts.option_digit) == ["2", "2", "2", "9", "", None]
    assert apply(spark, ["Answer: 2", "Correct Answer: 3", "Answer: (4)", "none"], prompts.digit_answer) == ["2", "3", "4", None]


def test_smiles(spark):
    assert [bool(x) for x in apply(spark, ["CC(=O)O", "C(", "C]", "", "C C"], chemistry.smiles_error)] == [False, True, True, True, True]


def test_subjects(spark):
    assert apply(spark, ["particle with a velocity", "oxidation state", "x"], classify.by_score) == ["Physics", "Chemistry", "Mathematics"]
    assert apply(spark, ["limit of a series", "acid and base", ""], classify.by_argmax) == ["Mathematics", "Chemistry", "Mathematics"]


def test_markdown_cases(spark):
    four = "(1) a\n(2) b\n(3) c\n(4) d\n"
    pages = [
        ("one", f"Q1. Find $x^2$\n\n{four}\nAnswer: 1\n"),
        ("three", "".join(f"Q{i}. What {i}\n{four}Answer: {a}\n" for i, a in ((1, 1), (2, 3), (3, 2)))),
        ("none", f"Q1. bare\n\nQ2. full\n{four}Correct Answer: 3"),
        ("short", "Q1. two\n(1) a\n(2) b\n"),
        ("lines", f"Q1. first\nsecond\nthird\n{four}"),
    ]
    df = spark.createDataFrame(pages, "paper_id string, content string")
    got = {}
    for r in segment.markdown_items(df).collect():
        got.setdefault(r.paper_id, []).append(r)
    assert [len(got.get(p, [])) for p, _ in pages] == [1, 3, 1, 0, 1]
    assert got["one"][0].correct_answer == "1" and "$x^2$" in got["one"][0].question_latex
    assert sorted((r.question_number, r.correct_answer) for r in got["three"]) == [(1, "1"), (2, "3"), (3, "2")]
    assert got["none"][0].question_number == 2 and got["lines"][0].correct_answer is None
    assert all(x in got["lines"][0].question_latex for x in ("first", "second", "third"))


def test_marker_segments(spark):
    texts = ["front", "Q1.", "stem", "(1)", "a", "(2)", "b", "(3)", "c", "(4)", "d", "Q2)", "inline (1) p (2) q (3) r (4) s", "Q3.", "no options", "Q4.", "", "Q5.", "x", "(1)", "old", "(1)", "new", "(2)", "b", "(3)", "c", "(4)", "d"]
    df = spark.createDataFrame([("p", i, i // 5 + 1, t) for i, t in enumerate(texts)], "paper_id string, pos int, page int, text string")
    got = {r.question_number: (r.question_text, r.options) for r in segment.marker_items(df).collect()}
    assert got == {1: ("stem", ["a", "b", "c", "d"]), 2: ("inline", ["p", "q", "r", "s"]), 3: ("no options", []), 5: ("x", ["new", "b", "c", "d"])}


def test_keys(spark):
    texts = [("q", "Q1. (2)\nQ2. (3)\nQ1. (4)"), ("n", "0. (9)\n1. (2)"), ("s9", " ".join("(1)" for _ in range(9))), ("s10", " ".join("(1)" for _ in range(10)))]
    got = answers.answer_key(spark.createDataFrame(texts, "paper_id string, text string")).collect()
    by = {}
    for r in got:
        by.setdefault(r.paper_id, {})[r.question_number] = r.answer
    assert by["q"] == {1: "4", 2: "3"} and by["n"] == {1: "2"} and "s9" not in by and len(by["s10"]) == 10


def test_dispositions(spark):
    rows = [("fill _____", None, "5"), ("fill _____", None, None), ("plain", ["a", "b", "c", "d"], "4"), ("plain", ["a", "b", "c", "d"], "0"), ("plain", ["a", " ", "c", "d"], "1"), ("as shown", ["a"], "1"), ("plain", ["a", "b", "c", "d"], ""), ("", None, "1")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, question_text string, options array<string>, answer_raw string")
    got = [r.disposition for r in filters.clean_items(df).orderBy("i").collect()]
    assert got == ["integer", "integer_without_answer", "mcq", "answer_out_of_range", "bad_options", "figure", "mcq_without_answer", "empty"]


def plain_items(spans):
    """P1 by hand, of one paper's (pos, page, text)."""
    out, seg = [], []
    for pos, page, text in [*sorted(spans), (None, 0, "Q0.")]:
        text = (text or "").strip()
        if m := re.match(r"^Q\s*\.?\s*(\d+)\s*[).:-]?$", text):
            if seg:
                out.append(seg)
            seg = [(pos, page, int(m[1]))]
        elif seg:
            seg.append((pos, page, text))
    items = {}
    for nth, ((_, _, number), *body) in enumerate(out, 1):
        marks = {x[2]: x[0] for x in body if re.match(r"^\([1-4]\)$", x[2])}
        first = min([x[0] for x in body if x[2] in marks], default=float("inf"))
        stem, options, at = [], [[], [], [], []], -1
        for pos, _, text in body:
            if text in marks:
                at += marks[text] == pos
            elif text and pos < first:
                stem.append(text)
            elif text and at >= 0:
                options[at].append(text)
        if stem:
            pages = [x[1] for x in body]
            items[nth] = (number, " ".join(stem), [" ".join(o) for o in options if o] if len(marks) == 4 else [], min(pages), max(pages))
    return items


def test_segments_follow_their_rule_and_are_sorted_once(spark):
    rng = random.Random(8)
    words = ["Q1.", "Q 2 )", "(1)", "(2)", "(3)", "(4)", "(5)", "a", " b ", "", None, "Q3 x"]
    papers = {f"p{k}": [(i, i // 9, rng.choice(words)) for i in range(300)] for k in range(3)}
    papers["whole"] = [(i, i, t) for i, t in enumerate(["Q7", "s", "(1)", "x", "(2)", "y", "(1)", "z", "(4)", "", "(3)", "u", "v"])]
    df = spark.createDataFrame([(k, *s) for k, spans in papers.items() for s in spans], "paper_id string, pos long, page int, text string").repartition(3)
    got = segment.marker_items(df)
    rows = {(r.paper_id, r.seg): (r.question_number, r.question_text, r.options, r.page_start, r.page_end) for r in got.collect()}
    assert rows == {(k, seg): item for k, spans in papers.items() for seg, item in plain_items(spans).items()}
    assert rows["whole", 1] == (7, "s", ["y", "z", "u v"], 1, 12)
    plan = got._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("Window [") == 1 and plan.count("collect_list") == 2  # in part, and in all


def test_whole_texts_are_cut_once(spark):
    from itemloom import plans

    plan = plans.QUERIES["q_loose_sections"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("^.*[:?]") == 1 and plan.count(r"Q\d+\.|") == 1


@pytest.mark.parametrize("unicode", [True, False])
def test_only_ends_are_stripped(spark, unicode):
    texts = ["", " ", "\n\t", "a", " a b\n", " a  b\u0085", "a \u0085", "\n\n😀 \r\n", "\x1c a", None, " " * 50 + "x" + " " * 50]
    white = "[ \t\n\x0b\f\r" + ("\x85\xa0  -     　" if unicode else "") + "]+"
    assert apply(spark, texts, lambda c: strip(c, unicode)) == [t if t is None else re.sub(rf"\A{white}|{white}\Z", "", t) for t in texts]


def test_errors_are_sought_once_and_plain_text_is_left_alone(spark):
    df = spark.createDataFrame([(t,) for t in ["plain (1) text", "a_bc 2^10", "é $x$ $y$", r"\mathbb{R}", "", None, "}{", "$a"]], "t string")
    error = df.select(latex.item_error("t", F.array("t", "t", "t", "t"), F.lit("mcq")).alias("e"))
    assert error._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") <= 6
    assert [r.e for r in error.collect()] == ["", "", "", r"Question: Contains \mathbb (broken output)", "", "", "Question: Unbalanced braces (extra })", "Question: Unbalanced $ signs"]
    assert [r.f for r in df.select(latex.fix_latex("t").alias("f")).collect()] == ["plain (1) text", "a_{bc} 2^{10}", "é$x y$", "R", "", "", "}{", "$a"]
