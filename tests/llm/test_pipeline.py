"""The pipeline against a brute-force statement of all its stages, with edge rows."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

pytest.importorskip("corpus_pipeline")
import corpus_pipeline  # noqa: E402
from itemloom.llm import simhash_dedup, toxicity, words  # noqa: E402

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, extra string"
LABELS = "doc_id long, quality int, toxic int"


def table():
    rng = random.Random(11)
    vocabulary = [f"{a}{b}" for a in ("ban", "cor", "dil", "fen", "gul", "har") for b in ("ta", "mo", "ri", "sel", "nu")]
    texts = []
    for i in range(160):
        t = [rng.choice(vocabulary) + rng.choice(vocabulary) for _ in range(rng.choice([5, 40, 90]))]
        if i % 6 == 0:
            t[2:2] = ["stupid", "fool", "stupidly"] * 3
        texts.append(" ".join(t))
    texts += [texts[1], texts[1].replace(" ", "\n "), texts[2] + " end", "", None, " \t", "one", texts[3].upper(), "w " * 4000]
    rows = [(i, t, "en", rng.choice(["s0", "s0", "s0", "s1", "s2", None]), len(t or ""), "e") for i, t in enumerate(texts)]
    rows += [rows[4], rows[4], (None, texts[7], None, None, None, None), (None, "an own text", None, "s1", None, None), (None, "an own text", None, "s1", None, None)]
    return rows, [(i, 1, int("stupid" in (t or ""))) for i, t, *_ in rows[:150]]


def score(model, text):
    """Mean over words of the mean over n-grams of the learnt numbers, one at a time."""
    found = re.findall(rb"[0-9A-Za-z\x80-\xff]+", (text or "").encode())
    total = 0.0
    for w in found:
        w = w.lower()
        h = int(words.Words(np.frombuffer(w, np.uint8), np.array([0, len(w)]), np.zeros(256, bool)).hashes()[0])
        grams = [h]
        padded = b"<" + w + b">"
        for k in toxicity.SIZES:
            for i in range(len(padded) - k + 1):
                g = 0
                for c in padded[i : i + k]:
                    g = (g * 0x100000001B3 + c + 1) & (1 << 64) - 1
                grams.append((g + k) & (1 << 64) - 1)
        mixed = words.mix(np.array(grams, dtype=np.uint64)) % np.uint64(toxicity.BUCKETS)
        total += float(model.value[mixed.astype(int)].mean())
    return 1 / (1 + math.exp(-max(-50, min(50, total / max(1, len(found)) + model.bias))))


def unique(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or "")].append(r)
    return [min(g, key=lambda r: (r[0] is None, r[0])) for g in groups.values()]


def apart(rows):
    fps = [simhash_dedup.fingerprint(r[1]) for r in rows]
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 3:
                up[root(i)] = root(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[root(i)] = min(least.get(root(i), r[0]), r[0])
    return [r for i, r in enumerate(rows) if r[0] is None or least[root(i)] == r[0]]


def mixed(rows):
    size = {id(r): len(WORD.findall(r[1] or "")) for r in rows}
    by = defaultdict(list)
    for r in rows:
        by[r[3]].append(r)
    names = sorted(s for s in by if s is not None) + [s for s in by if s is None]
    have = {s: sum(size[id(r)] for r in by[s]) for s in names}
    weight, target, free = {s: i % 3 + 1 for i, s in enumerate(names)}, {}, set(names)
    while True:
        left = sum(have.values()) - sum(target.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * have[s]]
        if not over:
            break
        for s in over:
            target[s] = 3 * have[s]
            free.remove(s)
    goal = {s: math.floor((target | share)[s] + 0.5) for s in names}
    total, ends = sum(goal.values()), np.cumsum([goal[s] for s in names])
    points = np.floor((np.arange(total) * 0.6180339887498949 % 1.0) * float(total))
    slots = Counter(names[i] for i in np.searchsorted(ends, points, side="right"))
    out = []
    for s in names:
        take = min(slots[s], 3 * have[s]) if slots[s] else goal[s]
        place = lambda r: hashlib.md5(f"{hashlib.md5((r[1] or '').encode()).hexdigest() if r[0] is None else r[0]}:mix".encode()).hexdigest()
        at = 0
        for r in sorted(by[s], key=place):
            n = size[id(r)]
            for turn in range(3):
                got = min(take, turn * have[s] + at + n) - turn * have[s] - at
                if n and got > 0 and 2 * got >= n:
                    out.append(r)
            at += n
    return out


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(pytest.importorskip("public_tokenizers").path("word_bpe_49k.json"))


def encoded(rows, tokenizer):
    out = Counter()
    for r in rows:
        ids = tokenizer.encode(r[1] or "", add_special_tokens=False).ids
        text = tokenizer.decode(ids, skip_special_tokens=False)
        out[(r[0], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())] += 1
    return out


def test_run_is_what_brute_force_gives(spark, tmp_path, tokenizer):
    rows, labels = table()
    docs, marks = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, LABELS)
    docs.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    marks.write.parquet(str(tmp_path / "labels.parquet"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "mixing", "bpe"]
    model = toxicity.fit(docs.select("doc_id", "text"), marks)
    clean = [r for r in rows if score(model, r[1]) < 0.7]
    assert len(rows) - 40 < len(clean) < len(rows)
    want = encoded(mixed(apart(unique(clean))), tokenizer)
    got = Counter(tuple(r[c] for c in ("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert got == want


def test_stages_return_the_columns_of_documents(spark, tmp_path):
    rows, labels = table()
    spark.createDataFrame(labels, LABELS).write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.createDataFrame(rows[:40], SCHEMA)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).schema.simpleString() == docs.schema.simpleString()


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], LABELS).write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
