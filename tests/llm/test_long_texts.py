"""Texts of tens of thousands of words through the operators that shuffle or cut them."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F
from test_operators import WORD, removed_by_brute_force

from itemloom.llm import exact_dedup, mixing, quality, sharding, simhash_dedup, substring_dedup, suffix_dedup


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(21)
    words = [f"w{i}" for i in range(3_000)] + ["É", "漢字"]
    long = [[rng.choice(words) for _ in range(n)] for n in (30_000, 45_000)]
    passage = [rng.choice(words) for _ in range(120)]
    long[0][20_000:20_000] = passage
    long[1][44_000:44_000] = passage
    long[1][100:100] = passage
    texts = [" ".join(t) for t in long]
    texts += [texts[0], texts[0] + "\n ", texts[1].replace(" ", "\t"), "x" * 100_000, "a b " * 20_000, " ".join(passage), "", None, "short one"]
    return [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)


@pytest.mark.parametrize(("operator", "window"), [(substring_dedup.substring_dedup, 35), (suffix_dedup.suffix_dedup, 50)])
def test_repeats(docs, rows, operator, window):
    got = operator(docs, window).select("doc_id", "n_words", "n_removed", "kept_sha256")
    assert Counter(map(tuple, got.collect())) == removed_by_brute_force(rows, window)


def test_simhash_and_exact(docs, rows):
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash_dedup.simhash_dedup(docs).collect()}
    fps = {r[0]: simhash_dedup.fingerprint(r[1]) for r in rows}
    assert {i: f for i, (f, _) in got.items()} == {i: f"{f:016x}" for i, f in fps.items()}
    assert got[2][1] == got[3][1] == got[0][1] == 0 and got[4][1] == got[1][1]
    groups = defaultdict(list)
    for r in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or "")].append(r[0])
    want = {i: (min(g), len(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for i in g}
    assert {r.doc_id: (r.keep_id, r.group_size, r.text_sha256) for r in exact_dedup.exact_dedup(docs).collect()} == want
    assert {r.doc_id for r in exact_dedup.unique_texts(docs).collect()} == {min(g) for g in groups.values()}


def test_mixing_and_sharding(docs, rows):
    mixed = {r.doc_id: r for r in mixing.mix(docs).collect()}
    assert {i: r["size"] for i, r in mixed.items()} == {r[0]: len(WORD.findall(r[1] or "")) for r in rows}
    sums = defaultdict(int)
    for r in rows:
        sums[r[3]] += mixed[r[0]]["taken"]
        assert mixed[r[0]]["taken"] <= 3 * mixed[r[0]]["size"]
    assert all(abs(sums[r[3]] - mixed[r[0]]["target"]) <= 4 for r in rows)
    shards = sharding.shard_by_bytes(docs).collect()
    assert Counter((r.doc_id, r["size"]) for r in shards) == Counter((r[0], len((r[1] or "").encode()) + 8) for r in rows)
    slots = defaultdict(list)
    for r in shards:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_quality_reads_whole_texts(spark, docs, rows):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(11)], "doc_id long, quality int, toxic int")
    score = {r.doc_id: r.score for r in quality.quality(docs, labels).collect()}
    tail = docs.where("doc_id = 6").withColumn("text", F.concat("text", F.lit(" END!!! " * 5_000)))
    again = {r.doc_id: r.score for r in quality.quality(docs.where("doc_id <> 6").unionByName(tail), labels).collect()}
    assert len(score) == len(rows) and all(0 <= s <= 1 for s in score.values()) and len(again) == len(rows)
