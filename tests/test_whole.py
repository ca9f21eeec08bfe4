"""Whole tables instead of id subsets, prefixes and literals, against plain statements of the rules."""

import hashlib
import math
import random
import re

import duckdb
from pyspark.sql import functions as F

from itemloom import plans
from itemloom.functions import graphemes, textnorm
from itemloom.operators import answers, retrieval
from itemloom.plans import bank

SF = "/root/testdata/sf0.001"


def test_all_boxes_meet(spark):
    rng = random.Random(3)
    boxes = [(i, *(x := [rng.uniform(-30, 30) for _ in range(2)]), *[v + rng.choice([0, 3, 25]) for v in x]) for i in range(120)]
    boxes += [(200 + i, 10.0, 10.0, 20.0, 20.0) for i in range(30)] + [(300, 20.0, 20.0, 20.0, 20.0), (301, 500.0, 0.0, 501.0, 1.0), (302, None, 0.0, 1.0, 1.0)]
    df = spark.createDataFrame(boxes, "id long, x0 double, y0 double, x1 double, y1 double").select("id", F.struct("x0", "x1", "y0", "y1").alias("box"))
    meet = lambda a, b: None not in a + b and not (a[3] < b[1] or b[3] < a[1] or a[4] < b[2] or b[4] < a[2])
    want = sorted((a[0], b[0]) for a in boxes for b in boxes if a[0] < b[0] and meet(a, b))
    assert sorted(map(tuple, retrieval.overlapping(df).collect())) == want
    counts = {b[0]: sum(b[0] in p for p in want) for b in boxes}
    assert dict(map(tuple, retrieval.overlap_counts(df).collect())) == counts and counts[301] == counts[302] == 0


def test_every_box_and_vector_id(spark):
    assert plans.QUERIES["q_box_overlap_counts"](spark, SF).count() == spark.read.parquet(f"{SF}/part.parquet").count()
    ids = spark.read.parquet(f"{SF}/embeddings.parquet").where("vec_id % 2 = 0")
    assert plans.QUERIES["q_zip_and_lookup_all"](spark, SF).count() == ids.count() > 20


def test_more_queries_than_a_block(spark):
    rng = random.Random(4)
    store = [(i, [rng.choice([0.0, 0.5, 1.5]) for _ in range(3)]) for i in range(60)] + [(100, None), (101, [0.0, None, 1.0]), (102, [0.5, 0.5]), (103, [float("nan")] * 3)]
    df = spark.createDataFrame(store, "vec_id long, embedding array<float>")
    asked = spark.createDataFrame([(i, v) for i, v in store if i % 3 == 0], "query_id long, query array<float>")
    got = retrieval.nearest_batch(df, asked, 4, most_queries=7, most_rows=11).collect()
    want = []
    for q, v in store:
        if q % 3 == 0 and v and None not in v and v[0] == v[0]:
            near = sorted((sum((a - b) ** 2 for a, b in zip(v, w)), i) for i, w in store if w and len(w) == len(v) and None not in w and w[0] == w[0])
            want += [(q, i, d, n + 1) for n, (d, i) in enumerate(near[:4])]
    assert sorted((r.query_id, r.vec_id, r.d2, r["rank"]) for r in got) == sorted(want) and len({w[0] for w in want}) > 7


def test_every_word_is_embedded(spark):
    long = " ".join(f"w{i}" for i in range(300))
    texts = [(0, "s", long), (1, "s", long + " last"), (2, "s", ""), (3, None, None), (4, "s", "жук"), (5, "s", "кот")]
    df = spark.createDataFrame(texts, "i int, source string, text string")
    got = {r.i: r for r in df.select("i", retrieval.hashed_embedding(retrieval.store_text("source", "text"), 16).alias("e"), F.xxhash64("text").alias("h")).collect()}
    assert got[0].e != got[1].e and got[4].e != got[5].e and abs(sum(x * x for x in got[3].e) - 1) < 1e-6
    words = {i: re.findall(r"\w+", f"topic {s or ''} question {t or ''}".lower()) for i, s, t in texts}
    hashes = dict(map(tuple, spark.createDataFrame([(w,) for w in {w for ws in words.values() for w in ws}], "w string").select("w", F.xxhash64("w")).collect()))
    for i, ws in words.items():
        bins = [0.0] * 16
        for w in ws:
            bins[hashes[w] % 16] += 1 if (hashes[w] >> 8) % 2 == 0 else -1
        norm = math.sqrt(sum(b * b for b in bins))
        assert all(abs(a - b / norm) < 1e-6 for a, b in zip(got[i].e, bins))
    assert spark.range(1).select(retrieval.hashed_embedding(F.lit(""), 4)).first()[0] == [0.0] * 4


def test_every_document_is_embedded(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert plans.QUERIES["q_hashed_embeddings_all"](spark, SF).where("size(embedding) = 16").count() == docs.count()


def test_whole_context_is_the_prompt(spark):
    talks = {}
    for r in spark.read.parquet(f"{SF}/conversations.parquet").orderBy("turn").collect():
        talks.setdefault(r.conv_id, []).append(r.text)
    want = {c: hashlib.md5("\n---\n".join(t[:3]).encode()).hexdigest() for c, t in talks.items()}
    got = {r.conv_id: (r.ok, r.h) for r in plans.QUERIES["q_variation_texts"](spark, SF).collect()}
    assert got == {c: (True, h) for c, h in want.items()}


class Scanner:
    """The rules as SURVEY states them, by hand: a rule looks at one place and says where it ends and what it leaves, or None."""

    blank = frozenset(" \t\n\x0b\f\r")

    def __init__(self, text):
        self.t = text

    def run(self, at, good):
        """The end of the stretch of characters that ``good`` accepts."""
        while at < len(self.t) and good(self.t[at]):
            at += 1
        return at

    def gap(self, at):
        return self.run(at, self.blank.__contains__)

    def digits(self, at):
        return self.run(at, lambda c: c in "0123456789")

    def ends_word(self, at):
        """Whether no word goes on here."""
        return at >= len(self.t) or not (self.t[at] == "_" or self.t[at].isascii() and self.t[at].isalnum())

    def starts_word(self, at):
        return at == 0 or not (self.t[at - 1] == "_" or self.t[at - 1].isascii() and self.t[at - 1].isalnum())

    def decimals(self, at):
        """The end of a point and the digits behind it; ``at`` where there is none."""
        return self.digits(at + 1) if self.t[at : at + 1] == "." and self.digits(at + 1) > at + 1 else at

    def named(self, at, names):
        return [at + len(n) for n in names if self.t.startswith(n, at)]

    def apply(self, rule):
        out, at = [], 0
        while at < len(self.t):
            end, left = rule(at) or (at + 1, self.t[at])
            out.append(left)
            at = end
        self.t = "".join(out)

    def decimal(self, at):
        if self.digits(at) > at:
            dot = self.gap(at + 1)
            last = self.gap(dot + 1)
            if self.t[dot : dot + 1] == "." and self.digits(last) > last:
                return last + 1, f"{self.t[at]}.{self.t[last]}"

    def unit(self, at):
        for end in dict.fromkeys([self.decimals(at + 1), at + 1]) if self.digits(at) > at else ():
            first = self.gap(end)
            last = self.run(first, lambda c: c.isascii() and c.isalpha())
            if 1 <= last - first <= 2 and self.ends_word(last):
                return last, f"{self.t[at:end]} {self.t[first:last]}"

    def small(self, at, most):
        """Ends of a number without a leading zero, of at most so many digits, the longest first."""
        return [at + n for n in range(min(most, self.digits(at) - at), 0, -1)] if self.t[at : at + 1] not in ("", "0") else []

    def fraction_of_units(self, at):
        if self.starts_word(at) and self.small(at, 1):
            second = self.gap(at + 1)
            third = self.gap(second + 1)
            if second > at + 1 and self.small(second, 1) and third > second + 1:
                for end in self.named(third, textnorm.FRACTION_UNITS):
                    if self.ends_word(end):
                        return end, f"{self.t[at]}/{self.t[second]} {self.t[third:end]}"

    def fraction_at_end(self, at):
        for end in self.small(at, 2) if self.starts_word(at) else ():
            second = self.gap(end)
            for last in self.small(second, 2) if second > end else ():
                rest = self.t[self.gap(last) : self.gap(last) + 1]
                if self.ends_word(last) and (rest == "" or rest in ",;:)"):
                    return last, f"{self.t[at:end]}/{self.t[second:last]}"

    def power_of_ten(self, at):
        end = self.decimals(self.digits(at)) if self.digits(at) > at else at
        cross = self.gap(end)
        ten = self.gap(cross + 1)
        if end > at and self.t[cross : cross + 1] in ("x", "X", "×") and self.t.startswith("10", ten):
            power = self.gap(ten + 2)
            power = self.gap(power + 1) if self.t[power : power + 1] == "^" else power
            if self.digits(power) > power:
                return self.digits(power), f"{self.t[at:end]} x 10^{self.t[power : self.digits(power)]}"

    def minus(self, at, must, signs="-−"):
        """(where the digits behind a sign begin, where they end), with blanks before the sign if ``must``."""
        sign = self.gap(at)
        first = self.gap(sign + 1)
        if (sign > at or not must) and self.t[sign : sign + 1] and self.t[sign] in signs and self.digits(first) > first:
            return first, self.digits(first)

    def negative_power(self, at):
        if self.t.startswith("10", at) and (found := self.minus(at + 2, False)):
            return found[1], f"10^-{self.t[found[0] : found[1]]}"

    def unit_power(self, at):
        for end in self.named(at, textnorm.POWER_UNITS):
            if found := self.minus(end, True):
                return found[1], f"{self.t[at:end]}^-{self.t[found[0] : found[1]]}"

    def bracket(self, at):
        if self.t[at] == "[":
            end = self.run(at + 1, lambda c: c not in "]\n\r\u0085\u2028\u2029")
            if self.t[end : end + 1] == "]":
                inner = Scanner(self.t[at : end + 1])
                inner.apply(inner.dimension)
                return end + 1, inner.t

    def dimension(self, at):
        sign = self.gap(at)
        if sign > at and self.gap(sign + 1) > sign + 1 and (found := self.minus(at, True, "−–-")):
            return found[1], f"^-{self.t[found[0] : found[1]]}"

    def function(self, at):
        for end in self.named(at, textnorm.FUNCTIONS) if self.starts_word(at) else ():
            first = self.gap(end)
            number = first + (self.t[first : first + 1] in ("-", "−"))
            last = self.decimals(self.digits(number))
            if first > end and self.digits(number) > number:
                return last, f"{self.t[at:end]}({self.t[first:last]})"

    def percent(self, at):
        for end in dict.fromkeys([self.decimals(at + 1), at + 1]) if self.digits(at) > at else ():
            if self.t[self.gap(end) : self.gap(end) + 1] == "%":
                return self.gap(end) + 1, f"{self.t[at:end]}%"

    def blanks(self, at):
        return (self.gap(at), " ") if self.gap(at) > at + 1 else None


def plain_normal(text):
    """N10 by hand."""
    s = Scanner("".join(textnorm.FOLD_TO[textnorm.FOLD_FROM.index(c)] if c in textnorm.FOLD_FROM else c for c in text))
    for rule in (s.decimal, s.unit, s.fraction_of_units, s.fraction_at_end, s.power_of_ten, s.negative_power, s.unit_power, s.bracket, s.function, s.percent, s.blanks):
        s.apply(rule)
    return s.t.strip("".join(s.blank))


def test_whole_texts_are_normalised(spark, tmp_path):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    docs += [(-1, None), (-2, ""), (-3, "a\x0b 5 %  " * 4000 + "2 9 m"), (-4, "7 . 5\n[M - 2]\t10 - 3 cos 3")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.chars, r.h) for r in plans.QUERIES["q_normalize_documents"](spark, str(tmp_path)).collect()}
    assert got.pop(-1) == (None, None)
    for i, text in docs:
        if text is not None:
            want = plain_normal(f"{text} {i}{bank.PHRASE}")
            assert got[i] == (len(want), hashlib.md5(want.encode()).hexdigest()), i


def test_letters_of_other_scripts_end_a_word(spark, tmp_path):
    texts = ["5mé 2 3 mß", "é1 2 m", "ü12 34, 7kgé", "5ḿ 1́ 2 N", "øsin 30 sin 30é", "٣1 2 R中", "4 5é; 4 5;"]
    docs = list(enumerate(texts))
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.h for r in plans.QUERIES["q_normalize_documents"](spark, str(tmp_path)).collect()}
    assert got == {i: hashlib.md5(plain_normal(f"{text} {i}{bank.PHRASE}").encode()).hexdigest() for i, text in docs}


#: Texts and their clusters.
CLUSTERED = [
    ["a", "e\u0301", "b"], ["x", "\U0001f468\u200d\U0001f469\u200d\U0001f467", "\u261d\U0001f3fd"], ["\U0001f1e9\U0001f1ea", "\U0001f1eb", "a"],
    ["\u0915\u094d\u0937\u093f", "\u0915"], ["\u0915\u200d", "\u0937"], ["\u1100\u1161\u11a8", "\uac01\u11a8", "\uac00", "\u1100"], ["\u0e01\u0e33", "\u0600a"],
    ["\xe4", "\r\n", "\n", "\r", "b"], ["a", "\r", "\n", "b"], ["\x00", "\xad", "\u0301", "\u200b", "\u200d"], ["\u261d\u200d", "a"], ["\xa9\u200d\xae", "\u4e2d"], ["\U0001f1e9\u0301", "\U0001f1ea"],
]


def test_clusters_stay_whole(spark):
    df = spark.createDataFrame([(i, "".join(c)) for i, c in enumerate(CLUSTERED)], "i int, text string")
    got = {r.i: (r.clusters, r.back) for r in df.select("i", graphemes.clusters("text").alias("clusters"), graphemes.reversed_text("text").alias("back")).collect()}
    for i, c in enumerate(CLUSTERED):
        assert got[i][1] == "".join(c[::-1]), c
        assert got[i][0] == c or "".join(c).isascii(), c


def test_polymorphic_texts_on_odd_texts(spark, tmp_path):
    rng = random.Random(6)
    pieces = [x for c in CLUSTERED for x in c] + list('"\\{}[] /\t\x1f\x7f\u2028\ufeff\uffff') + ['{"text":"x"}', '{"text":{"text":"x"}}', "null", "", "w\xf6rd "]
    texts = [None, "", "{", *map("".join, CLUSTERED), *("".join(rng.choices(pieces, k=rng.randint(0, 9))) for _ in range(2000))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    long = spark.range(1).select(F.lit(-1).cast("long").alias("doc_id"), F.repeat(F.lit("ab"), F.lit(10_000_001)).alias("text"))
    docs.union(long).write.parquet(f"{tmp_path}/documents.parquet")
    got = dict(map(tuple, plans.QUERIES["q_polymorphic_texts"](spark, str(tmp_path)).collect()))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert got == dict(con.execute(plans.ORACLES["q_polymorphic_texts"]).fetchall())
    assert len(got) == len(texts) + 1


def test_empty_texts_of_blocks(spark):
    blocks = '[{"text":""},{"text":"{a}"},{"page":1},{"text":{"text":"b"}},{"text":{"text":""}},{"text":"{\\"text\\":\\"c\\"}"},{"text":null}]'
    r = spark.range(1).select(answers.combined_text(F.lit(blocks)).alias("full"), answers.combined_text(F.lit(blocks), keep_empty=True).alias("all")).first()
    assert r.full == '{a}\nb\n{"text":"c"}' and r.all == '\n{a}\nb\n\n{"text":"c"}'
