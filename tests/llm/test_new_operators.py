"""Operators 11 to 13 against brute-force statements of their contracts, with edge rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from itemloom.llm import block_max, lexical, sketch, vector_codes

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, n int, terms string, item int, sk string, none boolean, id int, h string"


def low(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def texts(seed=5, n=80):
    rng = random.Random(seed)
    words = [f"w{int(rng.paretovariate(0.6)) % 300}" for _ in range(600)] + ["The", "É", "ß-x", "漢字", "a.b"]
    out = [" ".join(rng.choice(words) for _ in range(rng.choice([1, 4, 30, 150]))) for _ in range(n)]
    return out + [out[3], out[3], "", None, " \t\n", "...", "one", " ".join(rng.choice(words) for _ in range(30_000)), "w1 " * 4000, "x" * 70_000]


def corpus(seed=5):
    rows = [(i, t, 1, "t", 7, "k", True, 3, "h") for i, t in enumerate(texts(seed))]
    return [*rows, rows[4], (rows[6][0], "w1 w2 w3", *[None] * 7), (None, rows[7][1], *[None] * 7), (None, rows[7][1], *[None] * 7)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def ranked(rows, queries, k):
    """Scores every document for every query."""
    bags = [Counter(TERM.findall(low(r[1] or ""))) for r in rows]
    held = [b for b in bags if b]
    n, total = len(held), sum(sum(b.values()) for b in held)
    df = Counter(t for b in held for t in b)
    items = {}
    for item, text in queries:
        items.setdefault(item, set()).update(TERM.findall(low(text or "")))
    out = Counter()
    for item, terms in items.items():
        scored = []
        for r, b in zip(rows, bags, strict=True):
            m = 10 + 90 * sum(b.values()) * n // max(total, 1)
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * b[t] // (1000 * b[t] + 8 * m)) for t in terms if b[t])
            if s > 0:
                scored.append((-s, r[0] is None, r[0] or 0, r[0]))
        out.update((item, i + 1, x[3], -x[0]) for i, x in enumerate(sorted(scored, key=lambda x: x[:3])[:k]))
    return out


QUERIES = [(1, "w1 w2 W3, w1"), (2, "the É 漢字 nowhere"), (3, None), (4, "..."), (5, "w7 w7 a b x"), (5, "w9"), (None, "w4"), (8, " ".join(f"w{i}" for i in range(300))), (9, "nowhere"), (10, "x" * 70_000)]


@pytest.mark.parametrize(("query_terms", "postings"), [(lexical.QUERY_TERMS, lexical.SHARD_POSTINGS), (40, 300)])
def test_search(spark, docs, none, query_terms, postings):
    queries = spark.createDataFrame([(i, t, "x", 1) for i, t in QUERIES], "item_id long, text string, name string, rank int")
    got = lexical.search(docs, queries, k=10, query_terms=query_terms, shard_postings=postings)
    assert Counter(map(tuple, got.collect())) == ranked(corpus(), QUERIES, 10)
    if query_terms == lexical.QUERY_TERMS:
        assert lexical.search(none, queries).count() == 0 and lexical.search(docs, queries.limit(0)).count() == 0


def test_long_texts_are_counted_in_stretches():
    text = ("alpha " + "y" * 900 + " be-ta ") * 50 + "tail"
    raw = np.frombuffer(text.encode(), np.uint8)
    for limit in (100, 1000, 5000):
        got = Counter()
        for _, words in lexical.pieces(raw, np.array([0, len(raw)]), limit):
            got.update(bytes(words.raw[a:b]).decode() for a, b in zip(words.starts, words.ends, strict=True))
        assert got == Counter(TERM.findall(text))


def least_cost(score, longest, price):
    best = [0.0]
    for j in range(1, len(score) + 1):
        best.append(min(best[i] + (j - i) * max(score[i:j]) + price for i in range(max(0, j - longest), j)))
    return best[-1]


def test_blocks_cost_least():
    rng = np.random.default_rng(3)
    sizes = [0, 1, 2, 50, 130, 7, 0, 33]
    begin = np.cumsum([0, *sizes])
    score = rng.integers(1, 1000, begin[-1]).astype(float)
    starts = block_max.cut(score, begin, longest=16, price=2.0)
    assert set(begin[:-1][np.array(sizes) > 0]) <= set(starts.tolist())
    edge = np.append(starts, begin[-1])
    for lo, hi in zip(begin, begin[1:], strict=False):
        own = edge[(edge >= lo) & (edge <= hi)]
        if hi > lo:
            each = 2.0 * score[lo:hi].mean()
            cost = sum((b - a) * score[a:b].max() + each for a, b in zip(own, own[1:], strict=False))
            assert max(np.diff(own)) <= 16 and abs(cost - least_cost(score[lo:hi].tolist(), 16, each)) < 1e-6


def test_search_skips_blocks_and_loses_nothing():
    rng = np.random.default_rng(4)
    n, terms = 4000, 30
    where = [np.sort(rng.choice(n, rng.integers(5, 3000), replace=False)) for _ in range(terms)]
    doc, term = np.concatenate(where), np.repeat(np.arange(terms), [len(w) for w in where])
    score = (rng.pareto(1.5, len(doc)) * 100 + 1).astype(np.int64) * (1 + (doc < 200) * 20)
    shard = block_max.Shard(n, doc, term, score, terms)
    for size in (1, 3, 12, 30):
        asked = rng.choice(terms, size, replace=False)
        whole = np.zeros(n)
        np.add.at(whole, doc[np.isin(term, asked)], score[np.isin(term, asked)])
        edge = np.sort(whole)[-10]
        found, scores = shard.search(asked, 10, 0.0)
        assert (scores == whole[found]).all() and set(np.flatnonzero(whole >= edge)) <= set(found.tolist())
    assert shard.read < 0.6 * shard.held


def xx(data, seed=42):
    return xxhash.xxh64_intdigest(data, seed)


def sketched(text, size=5, scale=8):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    if not words:
        return []
    h = [xx(w.encode()) for w in words]
    out = []
    for i in range(max(1, len(h) - size + 1)):
        seed = 42
        for x in h[i : i + size]:
            seed = xx(x.to_bytes(8, "little"), seed)
        out.append(seed - (1 << 64) if seed >> 63 else seed)
    below = sorted({x for x in out if x < -(1 << 63) + (1 << 64) // scale})
    return below or [min(out)]


def like(a, b):
    least = min(len(a), len(b))
    return len(set(a) & set(b)) / least if least else float(len(a) == len(b))


def hexed(a):
    return "".join(f"{x & (1 << 64) - 1:016x}" for x in a)


def fingerprinted(rows):
    place = sorted({(r[0] is None, r[0] or 0, (lambda h: h - (1 << 64) if h >> 63 else h)(xx((r[1] or "").encode())), r[1] or "") for r in rows})
    after = {p: place[(i + 1) % len(place)] for i, p in enumerate(place)}
    out = Counter()
    for r in rows:
        t = r[1] or ""
        key = next(p for p in place if p[0] == (r[0] is None) and p[1] == (r[0] or 0) and p[3] == t)
        q = len(t) // 4
        edited = t[: len(t) - q] + after[key][3][:q]
        a, e, b = sketched(t), sketched(edited), sketched(after[key][3])
        out[(r[0], len(t), hashlib.sha256(edited.encode()).hexdigest(), hexed(a), hexed(e), round(like(a, e), 9), round(like(a, b), 9))] += 1
    return out


def test_fingerprints(spark, docs, none):
    got = Counter((*r[:5], round(r.near_edited, 9), round(r.near_next, 9)) for r in sketch.fingerprints(docs).collect())
    assert got == fingerprinted(corpus())
    unique = [r for r in corpus()[:40]]
    got = sketch.fingerprints(spark.createDataFrame(unique, SCHEMA).repartition(5))
    assert Counter((*r[:5], round(r.near_edited, 9), round(r.near_next, 9)) for r in got.collect()) == fingerprinted(unique)
    assert sketch.fingerprints(none).count() == 0
    one = sketch.fingerprints(spark.createDataFrame(unique[:1], SCHEMA)).first()
    assert one.near_next == 1.0
    assert [f.name for f in got.schema] == ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def test_sketches_merge_and_contain(spark):
    rng = random.Random(8)
    word = lambda: "v" + str(rng.randint(0, 10**6))
    small = " ".join(word() for _ in range(300))
    large = " ".join(word() for _ in range(9000))
    rows = [("a", small, large), ("b", "x y", small), ("c", "", small), ("d", "x y z", "p q")]
    df = spark.createDataFrame(rows, "k string, s string, t string")
    sk = lambda c: sketch.sketch(F.col(c))
    got = {r.k: r for r in df.select("k", sk("s").alias("s"), sk("t").alias("t"), sketch.merged(sk("s"), sk("t")).alias("m"), sk("t").alias("t2"), sketch.sketch(F.concat_ws(" ", "t", "s")).alias("u")).collect()}
    for k, s, t in rows:
        assert got[k].s == sketched(s) and got[k].t == sketched(t)
    union = sorted(set(sketched(small)) | set(sketched(large)))
    assert got["a"].m == union and like(got["a"].s, got["a"].u) == 1.0  # whole inside, thirty times longer
    assert got["c"].m == sketched(small) and got["b"].m == sorted({x for x in sketched("x y") + sketched(small) if x < -(1 << 63) + (1 << 61)}) and got["d"].m == [min(sketched("x y z") + sketched("p q"))]


def nearest_by_brute_force(x, book):
    d = ((x[:, None, :] - book[None, :, :]) ** 2).sum(axis=2)
    return d.argmin(axis=1), d.min(axis=1)


def test_partial_distance_search_is_exact_and_drops():
    rng = np.random.default_rng(6)
    for dim, entries, spread in ((8, 16, 500), (1, 3, 5), (5, 16, 3), (16, 2, 40), (8, 16, 1)):
        book = rng.integers(-spread, spread + 1, (entries, dim)) * np.linspace(3, 0, dim).astype(np.int64)
        x = rng.integers(-spread, spread + 1, (700, dim))
        entry, error, terms = vector_codes.nearest_entry(x, book)
        want, d = nearest_by_brute_force(x, book)
        assert (entry == want).all() and (error == d).all()
        assert dim < 8 or entries < 16 or spread < 100 or terms < 0.6 * x.size * entries


def coded_by_brute_force(rows, parts=8, entries=16, rounds=6):
    kept = [(i, lab, [math.floor(4096 * c) for c in v]) for i, v, lab in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    dims = Counter(len(v) for _, _, v in kept)
    if not kept:
        return Counter()
    dim = min(dims, key=lambda d: (-dims[d], d))
    kept = [(i, lab, v + [0] * (-dim % parts)) for i, lab, v in kept if len(v) == dim and all(abs(c) < 1 << 26 for c in v)]
    width = len(kept[0][2]) // parts
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[2]))[:entries]
    part = lambda v, p: v[p * width : (p + 1) * width]
    books = [[part(v, p) for _, _, v in first] for p in range(parts)]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda v, p: min(range(len(books[p])), key=lambda e: (dist(part(v, p), books[p][e]), e))
    for _ in range(rounds):
        held = [[[] for _ in b] for b in books]
        for _, _, v in kept:
            for p in range(parts):
                held[p][near(v, p)].append(part(v, p))
        books = [[[sum(c) // len(h) for c in zip(*h, strict=True)] if h else old for h, old in zip(hs, b, strict=True)] for hs, b in zip(held, books, strict=True)]
    out = []
    for i, lab, v in kept:
        code = [near(v, p) for p in range(parts)]
        out.append((i, lab, "".join(f"{c:02x}" for c in code), sum(dist(part(v, p), books[p][c]) for p, c in enumerate(code))))
    by = Counter()
    for _, lab, _, e in out:
        by[lab] += e
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return Counter((i, code, e, by[lab], digest) for i, lab, code, e in out)


def vectors(dim, n, seed=9):
    rng = random.Random(seed)
    rows = [(i * 3 % 101, [rng.gauss(0, 0.2) for _ in range(dim)], rng.choice([0, 0, 0, 1, None])) for i in range(n)]
    rows += [(200, None, 1), (201, [0.1, None] + [0.0] * (dim - 2), 1), (202, [float("nan")] * dim, 2), (203, [float("inf")] + [0.0] * (dim - 1), 2), (204, [0.0] * dim, None), (205, [0.1] * (dim + 1), 4), (206, [1e30] * dim, 4), (None, [0.3] * dim, 5), rows[0], (rows[1][0], [-0.5] * dim, 5)]
    return rows


@pytest.mark.parametrize(("dim", "n"), [(16, 90), (13, 40), (8, 3)])
def test_vector_codes(spark, dim, n):
    rows = vectors(dim, n)
    df = spark.createDataFrame([(*r, 1, "x", 2, "c") for r in rows], "vec_id long, embedding array<double>, label int, lk int, v string, e int, code string").repartition(3)
    got = vector_codes.compress(df)
    assert Counter(map(tuple, got.collect())) == coded_by_brute_force(rows)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]


def test_no_vectors(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert vector_codes.compress(spark.createDataFrame([], schema)).count() == 0
    assert vector_codes.compress(spark.createDataFrame([(1, None, 1), (2, [float("nan")], 1)], schema)).count() == 0
    assert vector_codes.compress(spark.createDataFrame([(1, [1e38, 1e38], 1)], schema)).count() == 0


def test_a_sample_is_bounded_by_rows(spark):
    from itemloom.llm.toxicity import labelled_sample

    ids = [i for i in range(1000) if zlib.crc32(str(i).encode()) % 3 != 1][:3]
    rows = spark.range(10_000).select(F.lit(ids[0]).cast("long").alias("doc_id"), F.concat(F.lit("t"), "id").alias("text"))
    rows = rows.union(spark.createDataFrame([(i, "other") for i in ids[1:]], "doc_id long, text string"))
    labels = spark.createDataFrame([(i, 1) for i in ids] * 2, "doc_id long, toxic int")
    got = labelled_sample(rows, labels, "toxic", 5)
    assert got.columns == ["doc_id", "text", "y"] and sorted(r.doc_id for r in got.collect()) == ids
    assert sorted(got.collect()) == sorted(labelled_sample(rows.repartition(7), labels, "toxic", 5).collect())


def test_long_texts_are_learnt_from_whole(spark):
    """The words that tell the labels apart stand at the end of long texts alone."""
    from itemloom.llm import toxicity

    rng = random.Random(12)
    words = [f"{a}{b}" for a in "bcdfghklmnp" for b in ("an", "or", "ed", "is")]
    filler = lambda n: [rng.choice(words) + rng.choice(words) for _ in range(n)]
    rows = [(i, " ".join(filler(5_000 if i % 40 == 0 else 20) + (["stupid", "fool"] * (250 if i % 40 == 0 else 2) if i % 4 == 0 else []))) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i, _ in rows], "doc_id long, toxic int")
    out = toxicity.toxicity(df, labels).collect()
    assert np.mean([r.predicted == int(r.doc_id % 4 == 0) for r in out if r.held_out]) > 0.97


def test_unseen_misspellings_share_vectors(spark):
    from itemloom.llm import toxicity

    rng = random.Random(13)
    words = [f"{a}{b}" for a in "bcdfghklmnp" for b in ("an", "or", "ed", "is")]
    filler = lambda: [rng.choice(words) + rng.choice(words) for _ in range(30)]
    rows = [(i, " ".join(filler() + (["worthless", "stupidity"] if i % 3 == 0 else []))) for i in range(900)]
    unseen = ["wortthless", "worthles", "worthlless", "stupidityy", "sstupidity", "stupiditi"]
    rows += [(10_000 + i, " ".join(filler() + [w, w])) for i, w in enumerate(unseen)] + [(20_000 + i, " ".join(filler())) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(900)], "doc_id long, toxic int")
    score = {r.doc_id: r.score for r in toxicity.toxicity(df, labels).collect()}
    assert min(score[10_000 + i] for i in range(len(unseen))) > max(score[20_000 + i] for i in range(20))


def test_slots_grow_with_sources(spark, monkeypatch):
    from itemloom.llm import mixing

    rng = random.Random(14)
    rows = [(i, "w " * rng.randint(100, 300), f"s{i % 400}") for i in range(4_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    def off(got):
        sums = got.assign(source=got.doc_id % 400).groupby("source").agg(taken=("taken", "sum"), target=("target", "first"))
        return (abs(sums.taken - sums.target) / sums.target).max()

    monkeypatch.setattr(mixing, "SLOTS", 1_000)
    whole, few = off(mixing.mix(docs).toPandas()), off(mixing.mix(docs, 1_000).toPandas())
    assert whole < 0.03 and few > 0.1


def test_near_copies_of_a_repeated_id_go(spark):
    from itemloom.llm import simhash_dedup

    a, b = (" ".join(f"{x}{i}" for i in range(60)) for x in "ab")
    schema = "doc_id long, text string, k_id string, h string, row int"
    for rows, want in (
        ([(5, a), (5, b), (3, b)], [(3, b), (5, a)]),
        ([(5, a), (5, a), (7, a)], [(5, a)]),
        ([(5, a), (5, a + "\n"), (None, a)], None),
        ([], []),
    ):
        df = spark.createDataFrame([(*r, "k", "x", 1) for r in rows], schema)
        got = simhash_dedup.near_unique(df)
        assert got.columns == df.columns
        found = sorted(((r.doc_id, r.text) for r in got.collect()), key=str)
        if want is None:
            assert len(found) == 2 and sum(i == 5 for i, _ in found) == 1 and (None, a) in found
        else:
            assert found == sorted(want, key=str)


def test_exact_search_finds_all(spark):
    from itemloom.llm import ann

    rng = np.random.default_rng(31)
    x = rng.normal(size=(900, 16))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {(r.query_id, r["rank"]): r.vec_id for r in ann.nearest(df, every=30, k=10, exact=True).collect()}
    want = {}
    for q in range(0, 900, 30):
        s = (x * x[q]).sum(axis=1)
        order = [i for i in np.lexsort((np.arange(900), -s)) if i != q][:10]
        want |= {(q, n + 1): int(i) for n, i in enumerate(order)}
    assert got == want


def figures_by_hand(text):
    """The content view of one text, counted byte by byte and word by word."""
    from itemloom.llm import quality, words

    raw = (text or "").encode()
    size = max(1, len(raw))
    kinds = [bytes(range(65, 91)), b"0123456789", bytes([*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]), b"\n"]
    found = [w for w in re.split(rb"[\x20\x09-\x0D]+", raw) if w]
    n = max(1, len(found))
    different = len(set(found))
    out = [sum(c in k for c in raw) / size for k in kinds]
    out += [sum(a == b for a, b in zip(found, found[1:], strict=False)) / n, different / n, math.log1p(different) / math.log1p(n), sum(map(len, found)) / n, math.log1p(len(found))]
    bins = [0.0] * quality.LEXICAL
    for w in found:
        h = int(words.Words(np.frombuffer(w, np.uint8), np.array([0, len(w)]), np.zeros(256, bool)).hashes()[0])
        bins[h % quality.LEXICAL] += quality.WEIGHT / n
    return np.array(out + bins, dtype=np.float32).astype(np.float64)


def places_by_hand(source, lang, n):
    from itemloom.llm import quality

    return [zlib.crc32(x.encode()) % quality.META for x in (f"s{source}", f"l{lang}", f"n{-1 if n is None else n.bit_length()}")]


def test_quality_scores_by_hand_and_without_leaks(spark):
    from itemloom.llm import quality
    from itemloom.llm.toxicity import held_out

    rng = random.Random(41)
    rows = []
    for i in range(420):
        t = " ".join(rng.choice(["alpha", "beta", "gamma", "É", "x1"]) + str(rng.randint(0, 30)) for _ in range(rng.randint(0, 60)))
        rows.append((i, t.upper().replace(" ", "!! \n") if i % 4 == 0 else t, rng.choice(["en", None]), rng.choice(["s1", "s2", None]), rng.choice([None, len(t)])))
    rows += [(900, None, None, None, None), (901, "", "en", "s1", 0), (902, " \t", "en", "s1", 2), rows[3], (None, rows[4][1], "en", "s1", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    known = [(i, int(i % 4 > 0), 0) for i in range(300)]
    labels = spark.createDataFrame(known, "doc_id long, quality int, toxic int")
    got = Counter((r.doc_id, round(r.score, 9)) for r in quality.quality(docs, labels).collect())
    staged = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "source", "lang", "n_chars").withColumn("held_out", held_out()).mapInArrow(quality.figures, quality.ROW).cache()
    model = quality.fit_quality(staged, labels)
    want = Counter()
    for i, text, lang, source, n in rows:
        x, view = figures_by_hand(text), model.views[0]
        z, at = view.weights[-1], quality.LEXICAL
        z += float(x[quality.FIGURES :] @ view.weights[: quality.LEXICAL])
        for j, edge in enumerate(view.edges):
            z += view.weights[at + sum(e <= x[j] for e in edge)]
            at += len(edge) + 1
        m = model.views[1].weights[-1] + sum(model.views[1].weights[p] for p in places_by_hand(source, lang, n))
        want[(i, round(1 / (1 + math.exp(-max(-50, min(50, z * model.blend[0] + m * model.blend[1] + model.blend[2])))), 9))] += 1
    off = [(a, b) for a, b in zip(sorted(got.elements(), key=str), sorted(want.elements(), key=str), strict=True) if a[0] != b[0] or abs(a[1] - b[1]) > 1e-5]
    assert not off, off[:3]
    flipped = spark.createDataFrame([(i, 1 - q if zlib.crc32(str(i).encode()) % 3 == 1 else q, t) for i, q, t in known], "doc_id long, quality int, toxic int")
    assert Counter((r.doc_id, round(r.score, 9)) for r in quality.quality(docs, flipped).collect()) == got
    assert {round(r.score, 6) for r in quality.quality(docs, labels.where("quality = 1")).collect()} == {1.0}
