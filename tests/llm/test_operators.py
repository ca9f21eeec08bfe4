"""Each operator against a brute-force statement of its contract, with edge rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from itemloom.llm import ann, bpe, components, exact_dedup, fm_index, fuse_filter, mixing, quality, sharding, simhash_dedup, sparse_suffix, substring_dedup, suffix_dedup, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, k_id string, mask int"


def corpus(seed=1, n=60):
    """Random texts with exact copies, near copies, shared passages, repeats, and edge rows."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)] + ["the", "a", "É x", "ß"]
    shared = [" ".join(rng.choice(words) for _ in range(70)) for _ in range(3)]
    texts = []
    for i in range(n):
        t = [rng.choice(words) for _ in range(rng.choice([0, 3, 30, 120, 200]))]
        if i % 4 == 0:
            t[len(t) // 2 : len(t) // 2] = shared[i % 3].split()
        texts.append(" ".join(t))
    texts += [texts[5], texts[5] + "\n", texts[6].replace(" ", "  "), "x " * 300, "", None, " \t\n", "one", texts[8] + " tail", "one two three " * 60]
    rows = [(i, t, rng.choice(["en", "de", None]), rng.choice(["s0", "s0", "s1", "s2", None]), len(t or ""), "k", 1) for i, t in enumerate(texts)]
    return rows + [rows[5], (None, texts[3], None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def as_bag(rows):
    return Counter(tuple(r) for r in rows)


def removed_by_brute_force(rows, window):
    words = [WORD.findall(r[1] or "") for r in rows]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for r, w in zip(rows, words, strict=True):
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((r[0], len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize(("operator", "window"), [(substring_dedup.substring_dedup, 35), (suffix_dedup.suffix_dedup, 50), (substring_dedup.substring_dedup, 10)])
def test_repeats(docs, none, operator, window):
    got = operator(docs, window).select("doc_id", "n_words", "n_removed", "kept_sha256")
    assert as_bag(got.collect()) == removed_by_brute_force(corpus(), window)
    assert operator(none, window).count() == 0


def test_spread_anchors_change_nothing(docs, monkeypatch):
    from itemloom.llm import repeats

    monkeypatch.setattr(repeats, "SPREAD", 0)
    monkeypatch.setattr(repeats, "PLACES", 1)
    got = substring_dedup.substring_dedup(docs, 35).select("doc_id", "n_words", "n_removed", "kept_sha256")
    assert as_bag(got.collect()) == removed_by_brute_force(corpus(), 35)


def test_matchers_agree_with_counting():
    rng = np.random.default_rng(0)
    for _ in range(20):
        k, window, n = 3, 6, 40
        gram = rng.integers(1, 4, k)
        segs, middle, weights = [], [], rng.integers(1, 3, n)
        for _ in range(n):
            left, right = rng.integers(1, 3, rng.integers(0, window - k + 1)), rng.integers(1, 3, window - k)
            segs.append(np.concatenate([left, gram, right]))
            middle.append(len(left))
        ids, offsets = np.concatenate(segs), np.cumsum([0, *map(len, segs)])
        seen = Counter()
        for s, w in zip(segs, weights, strict=True):
            for i in range(len(s) - window + 1):
                seen[tuple(s[i : i + window])] += int(w)
        want = [sum(1 << i for i in range(len(s) - window + 1) if seen[tuple(s[i : i + window])] > 1) for s in segs]
        args = (ids, offsets, weights, np.array(middle), window)
        assert fm_index.repeated_windows(*args).tolist() == want
        got = sparse_suffix.repeated_windows(*args).tolist()
        # the sparse form compares windows around the shared minimiser only
        around = defaultdict(int)
        for s, m, w in zip(segs, middle, weights, strict=True):
            for i in range(min(m, len(s) - window) + 1):
                around[(m - i, tuple(s[i : i + window]))] += int(w)
        assert got == [sum(1 << i for i in range(min(m, len(s) - window) + 1) if around[(m - i, tuple(s[i : i + window]))] > 1) for s, m in zip(segs, middle, strict=True)]


def test_matching_statistics():
    text = np.array([1, 2, 3, 1, 2, 3, 4, 1, 2])
    index = fm_index.FMIndex(text, np.array([0, 9]), np.array([1]))
    want = [max(n for n in range(10 - i) if sum(tuple(text[j : j + n]) == tuple(text[i : i + n]) for j in range(10 - n)) > 1 or n == 0) for i in range(9)]
    assert index.matching_statistics(text, np.array([0, 9])).tolist() == want


def labels_of(spark, rows):
    return spark.createDataFrame([(r[0], 1, int("stupid" in (r[1] or ""))) for r in rows if r[0] is not None], "doc_id long, quality int, toxic int")


def test_toxicity(spark, none):
    rng = random.Random(2)
    words = [f"{a}{b}" for a in "bcdfghklmnp" for b in ("an", "or", "ed", "is")]
    rows = []
    for i in range(900):
        t = [rng.choice(words) + rng.choice(words) for _ in range(rng.randint(30, 80))]
        if i % 5 == 0:
            t[3:3] = ["stupid", "stupidly", "fool"]
        rows.append((i, " ".join(t), None, None, None, None, None))
    rows += [(5000, None, *[None] * 5), (5001, "", *[None] * 5), (None, "stupid stupid", *[None] * 5), (5002, " ".join([rng.choice(words) + rng.choice(words) for _ in range(40)] + ["sstupid", "stupidd", "stupids"]), *[None] * 5)]
    df, labels = spark.createDataFrame(rows, SCHEMA), labels_of(spark, rows)
    out = toxicity.toxicity(df, labels).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in out)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in out)
    held = [(r.predicted, int(r.doc_id % 5 == 0)) for r in out if r.held_out and r.doc_id < 900]
    assert np.mean([p == y for p, y in held]) > 0.97
    scores = {r.doc_id: r.score for r in out}
    assert scores[5000] == scores[5001] < 0.5 and scores[5002] > 0.5
    flipped = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert {r.doc_id: r.score for r in toxicity.toxicity(df, flipped).collect()} == scores
    assert toxicity.toxicity(none, labels).count() == 0
    assert toxicity.toxicity(df, labels.where("toxic = 0")).agg(F.max("score")).first()[0] < 0.5
    kept = toxicity.without_toxic(df, labels)
    assert kept.columns == df.columns and kept.count() == sum(not r.predicted for r in out)


def test_simhash(docs, none):
    got = simhash_dedup.simhash_dedup(docs).collect()
    rows = corpus()
    fps = [simhash_dedup.fingerprint(r[1]) for r in rows]
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 3:
                up[max(root(i), root(j))] = min(root(i), root(j))
    ids = defaultdict(list)
    for i, r in enumerate(rows):
        if r[0] is not None:
            ids[root(i)].append(r[0])
    want = Counter((r[0], f"{fps[i]:016x}", min(ids[root(i)], default=None)) for i, r in enumerate(rows))
    assert as_bag(got) == want
    assert simhash_dedup.simhash_dedup(none).count() == 0
    kept = simhash_dedup.near_unique(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r[2] for r in want if r[2] is not None} | {None}


def test_fingerprint_by_its_definition(spark):
    text = "The quick brown Fox É jumps over the lazy dog"
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text).split(" ")
    df = spark.createDataFrame([(" ".join(w[i : i + 3]),) for i in range(len(w) - 2)], "s string").select(F.xxhash64("s"))
    h = [r[0] & (1 << 64) - 1 for r in df.collect()]
    want = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    assert simhash_dedup.fingerprint(text) == want
    assert simhash_dedup.fingerprint(None) == simhash_dedup.fingerprint("  ") == 0


def test_ball_hashing_misses_no_link():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    x = [base]
    for _ in range(4):
        x.append(x[-1] ^ (np.uint64(1) << rng.integers(0, 64, 40, dtype=np.uint64)))
    x = np.unique(np.concatenate(x))
    i, j = np.triu_indices(len(x), 1)
    near = np.bitwise_count(x[i] ^ x[j]) <= 3
    want = components.local_forest(x[i][near], x[j][near])
    got = components.local_forest(*simhash_dedup.ball_links(x))
    assert all((a == b).all() for a, b in zip(want, got, strict=True))


def test_heavy_keys_lose_no_row(spark):
    from itemloom.llm.skew import spread_join

    left = spark.range(5000).select((F.col("id") % 7 * (F.col("id") % 3)).alias("k"), "id")
    right = spark.createDataFrame([(i, f"n{i}") for i in range(0, 13)], "k long, name string")
    heavy = spark.createDataFrame([(0,), (4,)], "k long")
    assert as_bag(spread_join(left, right, ["k"], heavy).select("k", "id", "name").collect()) == as_bag(left.join(right, "k").collect())


def test_components_of_a_chain_and_a_hub(spark):
    from itemloom.llm.staging import Staged

    edges = [(i, i + 1) for i in range(40)] + [(1000, 1001 + i) for i in range(50)] + [(-5, 7), (3, 3)]
    got = components.connected_components(spark.createDataFrame(edges, "u long, v long"), Staged(spark, "test")).collect()
    want = {i: -5 for i in range(41)} | {-5: -5} | {1000 + i: 1000 for i in range(51)}
    assert {r.node: r.root for r in got} == want and len(got) == len(want)


def test_mixing(spark, docs, none):
    rows = corpus()
    got = mixing.mix(docs).toPandas()
    size = [len(WORD.findall(r[1] or "")) for r in rows]
    by = defaultdict(int)
    for r, s in zip(rows, size, strict=True):
        by[r[3]] += s
    order = sorted([s for s in by if s is not None]) + [s for s in by if s is None]
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    target, free = {}, set(order)
    while True:
        left = sum(by.values()) - sum(target.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * by[s]]
        if not over:
            break
        for s in over:
            target[s] = 3 * by[s]
            free.remove(s)
    target |= share
    assert len(got) == len(rows) and sorted(got["size"]) == sorted(size)
    assert (got.taken <= 3 * got["size"]).all()
    sums = got.groupby(["source_size", "target"]).taken.sum().reset_index()
    assert sorted(round(t, 6) for t in sums.target) == sorted(round(t, 6) for t in target.values())
    assert (abs(sums.target - sums.taken) <= 4).all()  # a block is one word here
    again = mixing.mix(docs.repartition(7)).toPandas()
    key = ["doc_id", "size", "taken"]
    assert Counter(map(tuple, got[key].astype(str).to_numpy())) == Counter(map(tuple, again[key].astype(str).to_numpy()))
    assert mixing.mix(none).count() == 0


def test_schedule_decides_the_mix(docs, monkeypatch):
    right = as_bag(mixing.mix(docs).collect())
    with monkeypatch.context() as m:
        m.setattr(mixing, "BROADCAST_SOURCES", 0)
        assert as_bag(mixing.mix(docs).collect()) == right
    with monkeypatch.context() as m:
        m.setattr(mixing, "GOLDEN", 0.0)
        assert as_bag(mixing.mix(docs).collect()) != right
    coarse = mixing.mix(docs, 40).toPandas()
    block = -(-coarse["size"].sum() // 40)
    sums = coarse.groupby(["source_size", "target"]).taken.sum().reset_index()
    whole = (sums.taken % block == 0) | (sums.taken == 3 * sums.source_size)
    assert whole.all() and (abs(sums.taken - sums.target) <= 3 * block).all()


def test_mixed_keeps_values_and_slot_order(spark, docs, none):
    rows = corpus()
    copies = [tuple(r) for r in mixing.mixed(docs).collect()]
    assert all(r in rows for r in copies) and mixing.mixed(none).count() == 0
    got = mixing.mix(docs).toPandas()
    words = sum(len(WORD.findall(r[1])) for r in copies)
    longest = got["size"].max()
    assert abs(words - got.taken.sum()) <= longest * got.target.nunique()
    assert max(Counter(r[0] for r in copies).values()) <= 6  # one doc_id stands twice in the table
    first = {r.doc_id: r.first_slot for r in mixing.mix(docs).collect() if r.first_slot is not None}
    seen = list(dict.fromkeys(r[0] for r in copies if r[0] is not None and got[got.doc_id == r[0]].shape[0] == 1))
    assert [first[i] for i in seen] == sorted(first[i] for i in seen)
    clash = spark.createDataFrame([(i, f"a b c {i}", "s", "mine", "t") for i in range(9)], "doc_id long, text string, source string, m_id string, sk string")
    assert sorted(map(tuple, mixing.mixed(clash).collect())) == [(i, f"a b c {i}", "s", "mine", "t") for i in range(9)]


def test_schedule_is_low_discrepancy(spark):
    from itemloom.llm.staging import Staged

    goals = spark.createDataFrame([("sa", 100, 100.0), ("sb", 600, 600.0), ("sc", 300, 300.0), ("sd", 0, 0.0)], "sk string, source_size long, target double")
    slots, sources, block = mixing.schedule(goals, Staged(spark, "test"))
    slots = slots.orderBy("slot").collect()
    assert block == 1 and [r.slot for r in slots] == list(range(1000))
    assert {r.sk: r.take for r in sources.collect()} == dict(Counter(r.sk for r in slots)) | {"sd": 0}
    for n in (10, 100, 1000):
        c = Counter(r.sk for r in slots[:n])
        assert all(abs(c[s] - n * p) <= 3 for s, p in (("sa", 0.1), ("sb", 0.6), ("sc", 0.3)))


def test_quality(spark, none):
    rng = random.Random(3)
    rows = []
    for i in range(600):
        t = " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) + str(rng.randint(0, 99)) for _ in range(40))
        bad = i % 4 == 0
        rows.append((i, t.upper().replace(" ", "!! ") if bad else t, "en", "s1" if bad else "s2", len(t), None, None))
    rows += [(9000, None, None, None, None, None, None), (None, "x", None, None, None, None, None)]
    labels = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(400)], "doc_id long, quality int, toxic int")
    out = quality.quality(spark.createDataFrame(rows, SCHEMA), labels).collect()
    assert len(out) == len(rows)
    held = [(r.predicted, int(r.doc_id % 4 > 0)) for r in out if r.held_out and r.doc_id < 600]
    assert np.mean([p == y for p, y in held]) > 0.98
    assert quality.quality(none, labels).count() == 0


@pytest.fixture(scope="module")
def tokenizer():
    public = pytest.importorskip("public_tokenizers")
    return public.path("word_bpe_49k.json")


def test_bpe(spark, docs, none, tokenizer):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(tokenizer)
    rng = random.Random(4)
    letters = "aAbBeoxyz'ssLLttreRE 0123.,;!?\n\t éÉßΣσςİı漢かな한́  \x1c\x85՘😀"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(300)]
    texts += ["ananan", "a" * 500, "<|endoftext|>x<|startoftext|>", "Don't 'S", "", None, "x" * 30_000, " \t"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r.doc_id: r for r in bpe.bpe_encode(df, tokenizer, whole=True).collect()}
    for i, t in enumerate(texts):
        ids = lib.encode(t or "", add_special_tokens=False).ids
        text = lib.decode(ids, skip_special_tokens=False)
        assert out[i].ids == ids and out[i].decoded == text and out[i].n_tokens == len(ids)
        assert out[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert out[i].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert bpe.bpe_encode(none, tokenizer).count() == 0 and bpe.bpe_encode(docs, tokenizer).count() == docs.count()


def test_plain_characters_are_the_librarys(tokenizer):
    """The quick path's characters, one by one and in context."""
    own = bpe.PairIndexBPE(tokenizer)
    for c in range(0x10000):
        ch = chr(c)
        if not 0xD800 <= c < 0xE000 and bpe.PLAIN.fullmatch(ch):
            text = f"a{ch}b{ch}{ch}1"
            folded = own.library.normalizer.normalize_str(text)
            want = [bytes(own.unletter[x] for x in t) for t, _ in own.library.pre_tokenizer.pre_tokenize_str(folded)]
            assert own.pretokens(text) == want, hex(c)


def test_neighbours(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(700, 24)).astype(np.float32) * rng.uniform(0.5, 2, size=(700, 1)).astype(np.float32)
    x[300:330] = x[299]
    rows = [(i, v.tolist(), "c") for i, v in enumerate(x)]
    rows += [(2000, None, "c"), (2020, [0.0] * 24, "c"), (2040, [float("nan")] * 24, "c"), (2060, [None] * 24, "c"), (None, [1.0] * 24, "c"), (2080, [1.0] * 3, "c"), (2100, [], "c")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank string")
    got = defaultdict(list)
    for r in ann.nearest(df).collect():
        got[r.query_id].append(r)
    assert sorted(got) == list(range(0, 700, 20))
    y, hit = x.astype(np.float64), 0
    for q, found in got.items():
        found.sort(key=lambda r: r.rank)
        s = (y * y[q]).sum(axis=1)
        want = [int(i) for i in np.lexsort((np.arange(700), -s)) if i != q][:20]
        hit += len({r.vec_id for r in found} & set(want))
        assert [r.rank for r in found] == list(range(1, 21)) and q not in [r.vec_id for r in found]
        assert all(abs(r.score - s[r.vec_id]) < 1e-12 for r in found)
        assert [(-r.score, r.vec_id) for r in found] == sorted((-r.score, r.vec_id) for r in found)
    assert hit / (20 * len(got)) >= 0.9
    few = ann.nearest(df.where("vec_id < 7"))
    assert few.count() == 6
    assert ann.nearest(df.where("vec_id < 0")).count() == 0


def test_neighbours_of_a_repeated_vec_id(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.9, 0.1]), (1, [0.2, 0.9]), (1, [0.9, 0.1]), (2, [-1.0, 0.0])]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in sorted(got, key=lambda r: r.rank)] == [(0, 1, 1, 0.9), (0, 2, 2, -1.0)]


def test_multi_index_retrieves_the_whole_ball_from_posted_codes_alone():
    rng = np.random.default_rng(6)
    codes = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    for radius in (0, 7, 20, 31, 64):
        index = ann.MultiIndex(codes)
        limit = np.full(20, radius)
        limit[3] = max(0, radius - 5)
        q, c = index.within(codes[:20], limit)
        want = np.bitwise_count(codes[:20, None] ^ codes[None, :]) <= limit[:, None]
        assert len(q) == want.sum() and want[q, c].all()
        assert radius > 7 or index.compared <= 0.1 * 20 * 300


@pytest.mark.parametrize(("noise", "share"), [(0.05, 0.15), (0.3, 0.3)])
def test_neighbours_in_clusters_visit_little(noise, share):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(40, 32))
    x = (centres[rng.integers(0, 40, 8000)] + noise * rng.normal(size=(8000, 32))).astype(np.float32)
    sample = x[:2000].astype(np.float64)
    codes = ann.learn(sample, float(np.linalg.norm(x, axis=1).max()))
    shard = ann.Shard(np.arange(8000), x, codes)
    q_ids = np.arange(0, 8000, 200)
    q = x[q_ids].astype(np.float64)
    found = shard.search(q_ids, q, ann.radii(q, sample, codes, 8000, 20).astype(np.int64), 20).to_pydict()
    score = q @ x.T.astype(np.float64)
    score[np.arange(len(q)), q_ids] = -np.inf
    want = {(int(i), int(v)) for i, row in zip(q_ids, np.argsort(-score, axis=1)[:, :20], strict=True) for v in row}
    assert len(want & set(zip(found["query_id"], found["vec_id"], strict=True))) >= 0.9 * len(want)
    assert shard.index.compared <= share * len(q) * 8000


def test_sharding(spark, docs, none):
    rows = corpus()
    got = sharding.shard_by_bytes(docs, 6).toPandas()
    size = Counter((r[0], len((r[1] or "").encode()) + 8, zlib.crc32((r[1] or "").encode())) for r in rows)
    as_id = [None if np.isnan(i) else int(i) for i in got.doc_id]
    assert Counter(zip(as_id, got["size"], got.text_crc32, strict=True)) == size
    for _, part in got.groupby("shard"):
        assert sorted(part.slot) == list(range(len(part)))
    bytes_ = got.groupby("shard")["size"].sum()
    assert len(bytes_) == 6 and bytes_.max() - bytes_.min() <= 0.1 * bytes_.mean()
    again = sharding.shard_by_bytes(docs.repartition(5), 6).toPandas()
    key = ["doc_id", "shard", "slot", "text_crc32"]
    assert sorted(map(str, got[key].to_numpy().tolist())) == sorted(map(str, again[key].to_numpy().tolist()))
    assert sharding.shard_by_bytes(none).count() == 0
    assert sharding.shard_by_bytes(docs.limit(2)).count() == 2


@pytest.mark.parametrize("ids", ["id", "case when id >= 1200 then id end", "case when id < 1200 then 7 else id end"])
def test_sharding_of_one_huge_group(spark, ids):
    """A huge group with ids of its own, with none, and with one id throughout."""
    df = spark.range(3000).select(F.expr(ids).alias("doc_id"), F.when(F.col("id") < 1200, "same text here " * 20).otherwise(F.concat(F.lit("text "), F.col("id").cast("string"))).alias("text"))
    got = sharding.shard_by_bytes(df).toPandas()
    b = got.groupby("shard")["size"].sum()
    assert len(b) == 24 and b.max() <= 1.05 * b.mean() and b.min() >= 0.95 * b.mean()
    again = sharding.shard_by_bytes(df.repartition(5)).toPandas()
    key = ["doc_id", "shard", "slot", "text_crc32"]
    assert sorted(map(str, got[key].to_numpy().tolist())) == sorted(map(str, again[key].to_numpy().tolist()))
    for _, part in got.groupby("shard"):
        assert sorted(part.slot) == list(range(len(part)))


def test_exact_dedup(docs, none, monkeypatch):
    rows = corpus()
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or "") for r in rows]
    ids = defaultdict(list)
    for r, t in zip(rows, norm, strict=True):
        ids[t].append(r[0])
    want = Counter()
    seen = set()
    for r, t in zip(rows, norm, strict=True):
        named = [i for i in ids[t] if i is not None]
        keep = min(named, default=None)
        first = r[0] == keep and (t, r[0]) not in seen
        seen.add((t, r[0]))
        want[(r[0], keep, len(ids[t]), first, hashlib.sha256(t.encode()).hexdigest())] += 1
    for part in (None, F.lit(True), F.lit(False)):
        assert as_bag(exact_dedup.exact_dedup(docs, part).collect()) == want
    # beyond the broadcast bound the same steps are shuffles
    monkeypatch.setattr(exact_dedup, "BROADCAST_BYTES", 0)
    assert as_bag(exact_dedup.exact_dedup(docs).collect()) == want
    assert exact_dedup.unique_texts(docs).count() == len(ids)
    assert exact_dedup.exact_dedup(none).count() == 0


def test_unique_texts_keeps_columns_and_values(spark, docs, none):
    rows = corpus()
    kept = exact_dedup.unique_texts(docs)
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    assert kept.columns == docs.columns and exact_dedup.unique_texts(none).count() == 0
    got = [tuple(r) for r in kept.collect()]
    assert sorted(norm(r[1]) for r in got) == sorted({norm(r[1]) for r in rows}) and all(r in rows for r in got)
    names = "doc_id long, text string, k_id string, digest string, keep string, row string, g_old string"
    clash = spark.createDataFrame([(1, "a", "mine", "d", "k", "r", "o"), (2, "a", "other", "d", "k", "r", "o"), (3, "b", "mine", "x", "y", "z", "w"), (None, "c", *"vwxyz"), (None, "c", *"vwxyz")], names)
    assert sorted(map(tuple, exact_dedup.unique_texts(clash).where("doc_id is not null").collect())) == [(1, "a", "mine", "d", "k", "r", "o"), (3, "b", "mine", "x", "y", "z", "w")]
    assert exact_dedup.unique_texts(clash).where("doc_id is null").count() == 1


def test_filter_and_byte_check_decide(docs, monkeypatch):
    """A filter that misses, or a check that always fails, leaves the two sides apart; so does a digest that collides."""
    right = as_bag(exact_dedup.exact_dedup(docs).collect())
    with monkeypatch.context() as m:
        m.setattr(exact_dedup, "marked", lambda filters, batch, buckets: pa.array(np.zeros(batch.num_rows, dtype=bool)))
        m.setattr(exact_dedup, "BROADCAST_BYTES", 0)
        assert as_bag(exact_dedup.exact_dedup(docs).collect()) != right
    with monkeypatch.context() as m:
        plain = exact_dedup.confirmed
        m.setattr(exact_dedup, "confirmed", lambda shared, d: plain(shared, d).where("false"))
        assert as_bag(exact_dedup.exact_dedup(docs).collect()) != right
    with monkeypatch.context() as m:
        m.setattr(exact_dedup, "digest_of", lambda text: F.encode(F.least(F.length(text), F.lit(1)).cast("string"), "UTF-8"))
        two = docs.where("text like '% tail' or doc_id = 7")
        out = exact_dedup.exact_dedup(two, F.col("doc_id") == 7).collect()
        assert sorted((r.doc_id, r.keep_id, r.group_size) for r in out) == sorted((r.doc_id, r.doc_id, 1) for r in out) and len(out) == 2


@pytest.mark.parametrize("n", [0, 1, 2, 3, 17, 1000, 60_000])
def test_fuse_filter_has_no_false_negatives(n):
    rng = np.random.default_rng(n)
    keys = rng.integers(0, 1 << 63, n, dtype=np.uint64)
    held = fuse_filter.BinaryFuseFilter.from_bytes(fuse_filter.BinaryFuseFilter(keys).to_bytes())
    assert held.contains(keys).all()
    assert held.contains(rng.integers(0, 1 << 63, 20_000, dtype=np.uint64)).mean() < 0.01


def test_all_eleven_are_registered():
    known = entry.queries()
    assert all(any(q.startswith(f"op{n}_") for q in known) for n in range(1, 11)) and "pipeline" in known
