"""Operator 2, toxicity by subword-bag embeddings and a linear softmax.

A word's vector is the mean of the vectors of its character n-grams and of the
word itself (hashed into buckets); a text's vector is the mean over its words;
a linear softmax reads the label off it.  All are trained together in numpy on
a bounded sample of labelled rows.  A misspelling shares most n-grams with the
word that it hides, so it shares its vector.

Executors turn the sampled texts, whole, into weights of buckets; Spark counts
how many texts of each label hold a bucket; the driver gets the weights of the
buckets that tell the labels apart, never a text.

Means and the softmax's input are linear, so a trained model is one number for
each bucket (a difference of logits), and scoring a text is a mean of numbers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from .memory import give_back
from .staging import Staged
from .words import Words, chunks, mix, text_buffers

BUCKETS = 1 << 17
SIZES = (3, 4, 5)
#: Labelled rows used for training at most, those of smallest hash of doc_id.
SAMPLE = 5_000
#: Buckets in fewer training texts than this share, or telling the labels apart less surely, are not learnt.
LEAST_SHARE = 0.003
LEAST_Z = 4.0
#: Length of the steps of the embeddings, their dimensions, and the spread of their random start.
STEP = 20.0
DIM = 4
START = 0.01

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_NO_WORD = np.ones(256, dtype=bool)
_NO_WORD[128:] = False
_NO_WORD[[*range(ord("0"), ord("9") + 1), *range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1)]] = False
_STEP = np.uint64(0x100000001B3)


class Bag:
    """Different words of some texts, their n-gram buckets, and which text holds which."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray):
        words = Words(raw, offsets, _NO_WORD)
        words.raw = _LOWER[words.raw]
        self.n_docs = words.n_docs
        self.per_doc = np.diff(words.first)
        self.doc = words.doc
        if not len(words):
            self.word = np.zeros(0, np.int64)
            self.buckets, self.owner = np.zeros(0, np.int64), np.zeros(0, np.int64)
            self.n_words, self.grams = 0, np.zeros(0)
            return
        h, first, self.word = np.unique(words.hashes(), return_index=True, return_inverse=True)
        self.n_words = len(h)
        start, end = words.starts[first], words.ends[first]
        size = end - start + 2
        close = np.cumsum(size)
        open_ = close - size
        n = int(close[-1])
        owner = np.repeat(np.arange(len(size)), size)
        at = start[owner] + np.arange(n) - open_[owner] - 1
        text = words.raw[np.clip(at, 0, len(words.raw) - 1)].astype(np.uint64)
        text[open_] = ord("<")
        text[close - 1] = ord(">")
        buckets, owners = [(mix(h) % np.uint64(BUCKETS)).astype(np.int32)], [np.arange(len(size), dtype=np.int32)]
        owner = owner.astype(np.int32)
        for k in SIZES:
            if n < k:
                continue
            g = np.zeros(n - k + 1, dtype=np.uint64)
            for t in range(k):
                g = g * _STEP + text[t : t + n - k + 1] + np.uint64(1)
            inside = owner[: n - k + 1] == owner[k - 1 :]
            buckets.append((mix(g[inside] + np.uint64(k)) % np.uint64(BUCKETS)).astype(np.int32))
            owners.append(owner[: n - k + 1][inside])
        self.buckets, self.owner = np.concatenate(buckets), np.concatenate(owners)
        self.grams = np.bincount(self.owner, minlength=self.n_words)

    def weights(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, bucket, weight), by text and bucket: what each bucket's number counts for in the mean of each text."""
        none = np.zeros(0, np.int64)
        if not self.n_words:
            return none, none, np.zeros(0)
        pair, count = np.unique(self.doc * np.int64(self.n_words) + self.word, return_counts=True)
        doc, word = pair // self.n_words, pair % self.n_words
        order = np.argsort(self.owner, kind="stable")
        buckets, first = self.buckets[order], np.searchsorted(self.owner[order], np.arange(self.n_words + 1))
        share = count / self.per_doc[doc] / self.grams[word]
        keys, sums = [], []
        edge = np.searchsorted(doc, np.arange(self.n_docs + 1))
        for d in range(self.n_docs):
            w = word[edge[d] : edge[d + 1]]
            n = first[w + 1] - first[w]
            at = np.repeat(first[w] - np.cumsum(n) + n, n) + np.arange(n.sum())
            own, back = np.unique(buckets[at], return_inverse=True)
            keys.append(d * np.int64(BUCKETS) + own)
            sums.append(np.bincount(back, np.repeat(share[edge[d] : edge[d + 1]], n), len(own)))
        key = np.concatenate(keys)
        return key // BUCKETS, key % BUCKETS, np.concatenate(sums)

    def word_values(self, value: np.ndarray) -> np.ndarray:
        """Mean bucket value of each different word."""
        return np.bincount(self.owner, weights=value[self.buckets], minlength=self.n_words) / self.grams if self.n_words else np.zeros(0)

    def means(self, value: np.ndarray) -> np.ndarray:
        """Mean word value of each text (0 where there is no word)."""
        w = self.word_values(value)
        return np.bincount(self.doc, weights=w[self.word], minlength=self.n_docs) / np.maximum(self.per_doc, 1)


@dataclass
class Model:
    """Difference of logits for each bucket, and for the text without words."""

    value: np.ndarray
    bias: float

    def scores(self, bag: Bag) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(bag.means(self.value) + self.bias, -50, 50)))


@dataclass
class Weights:
    """Some labelled texts as weights of buckets (text, bucket and weight of each entry)."""

    label: np.ndarray
    doc: np.ndarray
    bucket: np.ndarray
    weight: np.ndarray

    def means(self, value: np.ndarray) -> np.ndarray:
        return np.bincount(self.doc, self.weight * value[self.bucket], len(self.label))

    def vectors(self, emb: np.ndarray) -> np.ndarray:
        """Each text's vector."""
        return np.stack([self.means(emb[:, j]) for j in range(emb.shape[1])], axis=1)

    def back(self, d_text: np.ndarray) -> np.ndarray:
        """What the texts' gradients come to for each bucket."""
        return np.stack([np.bincount(self.bucket, self.weight * d_text[self.doc, j], BUCKETS) for j in range(d_text.shape[1])], axis=1)


def train(rows: Weights, check: Weights, dim: int = DIM, rounds: int = 60, rate: float = 0.1, patience: int = 8, seed: int = 7) -> Model:
    """Embeddings and softmax trained together by normalised gradient steps, from random vectors.

    A bucket's vector is scaled by the inverse root of its share in the texts,
    so that rare and frequent n-grams start equal.  The round with the least
    log loss on the texts of ``check`` is kept.
    """
    rng = np.random.default_rng(seed)
    label = rows.label
    positive = float(label.mean()) if len(label) else 0.0
    if not 0 < positive < 1:
        return Model(np.zeros(BUCKETS), -50.0 if positive < 0.5 else 50.0)
    if not len(rows.bucket):
        return Model(np.zeros(BUCKETS), float(np.log(positive / (1 - positive))))
    mass = np.bincount(rows.bucket, rows.weight, BUCKETS) / len(label)
    scale = np.where(mass > 0, 1 / np.sqrt(np.maximum(mass, 1e-12)), 0.0)[:, None]
    params = [rng.normal(0, START, size=(BUCKETS, dim)), rng.normal(0, 0.5, size=(dim, 2)), np.log([1 - positive, positive])]
    speed = [np.zeros_like(p) for p in params]
    target = np.eye(2)[label]
    best, best_loss, since = Model(np.zeros(BUCKETS), float(params[2][1] - params[2][0])), np.inf, 0
    for _ in range(rounds):
        emb, soft, bias = params
        texts = rows.vectors(emb * scale)
        logit = texts @ soft + bias
        logit -= logit.max(axis=1)[:, None]
        p = np.exp(logit)
        p /= p.sum(axis=1)[:, None]
        err = (p - target) / len(label)
        d_emb = rows.back(err @ soft.T) * scale
        for i, g in enumerate((d_emb, texts.T @ err, err.sum(axis=0))):
            step = (rate if i else STEP) * g
            speed[i] = 0.8 * speed[i] - step
            params[i] = params[i] + speed[i]
        emb, soft, bias = params
        now = Model(((emb * scale) @ (soft[:, 1] - soft[:, 0])), float(bias[1] - bias[0]))
        s = np.clip(1 / (1 + np.exp(-np.clip(check.means(now.value) + now.bias, -50, 50))), 1e-9, 1 - 1e-9)
        loss = -float(np.mean(np.where(check.label == 1, np.log(s), np.log(1 - s)))) if len(s) else 0.0
        if loss < best_loss - 1e-5:
            best, best_loss, since = now, loss, 0
        else:
            since += 1
            if since >= patience:
                break
    return calibrated(best, check)


def calibrated(model: Model, check: Weights, steps: int = 50) -> Model:
    """Slope and intercept of the logits fitted on held-back texts (Newton's method, slightly damped)."""
    x = np.stack([check.means(model.value) + model.bias, np.ones(len(check.label))], axis=1)
    w = np.array([1.0, 0.0])
    prior = np.array([1.0, 0.0])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
        grad = x.T @ (p - check.label) + 0.1 * (w - prior)
        w = w - np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(2), grad)
        w[0] = max(w[0], 0.1)
    return Model(model.value * w[0], float(model.bias * w[0] + w[1]))


def held_out() -> F.Column:
    """Whether a row's label may not be learnt from: crc32 of the doc_id's digits leaves 1 modulo 3."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, sample: int) -> DataFrame:
    """At most ``sample`` rows (doc_id, y, columns of docs) whose labels may be learnt from, one for each doc_id.

    The ids are drawn from the labels alone (smallest hashes), so the join's
    broadcast side has at most ``sample`` rows.  Of rows that share a doc_id,
    that of the smallest hash is learnt from; tasks choose before they shuffle.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).where(~held_out())
    known = known.groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("y"))
    drawn = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.join(F.broadcast(drawn), "doc_id")
    row = F.struct(*[c for c in rows.columns if c != "doc_id"])
    return rows.groupBy("doc_id").agg(F.min_by(row, F.xxhash64(*docs.columns)).alias("r")).select("doc_id", "r.*")


def bucket_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole texts to the weights of their buckets."""
    for batch in batches:
        raw, off = text_buffers(batch.column("text"))
        for lo, hi in chunks(off):
            doc, bucket, weight = Bag(raw, off[lo : hi + 1]).weights()
            cut = pa.array(np.searchsorted(doc, np.arange(hi - lo + 1)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(cut, x) for x in (pa.array(bucket.astype(np.int32)), pa.array(weight.astype(np.float32)))]
            some = batch.slice(lo, hi - lo)
            yield pa.RecordBatch.from_arrays([some.column("doc_id"), some.column("y"), *lists], names=["doc_id", "y", "buckets", "weights"])


def telling(rows: DataFrame) -> np.ndarray:
    """The buckets whose presence differs between the labels, ascending.

    A bucket must be in ``LEAST_SHARE`` of the texts, and the difference of its
    shares ``LEAST_Z`` standard errors; others would be learnt by heart.
    """
    n = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    total = max(1, sum(n.values()))
    n0, n1 = max(1, n.get(0, 0)), max(1, n.get(1, 0))
    has = rows.select("y", F.explode("buckets").alias("bucket")).groupBy("bucket").agg(F.sum(1 - F.col("y")).alias("h0"), F.sum("y").alias("h1"))
    p = (F.col("h0") + F.col("h1")) / total
    error = F.sqrt(F.greatest(p * (1 - p), F.lit(1e-12)) * (1 / n0 + 1 / n1))
    good = (F.abs(F.col("h1") / n1 - F.col("h0") / n0) >= LEAST_Z * error) & (F.col("h0") + F.col("h1") >= max(3, LEAST_SHARE * total))
    return np.sort(has.where(good).select("bucket").toArrow().column("bucket").to_numpy()).astype(np.int64)  # at most BUCKETS


def gathered(rows: DataFrame, good: np.ndarray) -> Weights:
    """The rows' weights of the buckets in ``good``, on the driver: at most as many rows as the sample has."""
    sent = rows.sparkSession.sparkContext.broadcast(good)

    def narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("buckets")
            size = np.diff(lists.offsets.to_numpy())
            bucket, weight = lists.flatten().to_numpy(), batch.column("weights").flatten().to_numpy()
            keep = np.isin(bucket, sent.value)
            cut = pa.array(np.concatenate([[0], np.cumsum(np.bincount(np.repeat(np.arange(len(size)), size)[keep], minlength=len(size)))]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(cut, pa.array(x[keep])) for x in (bucket, weight)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), *lists], names=["doc_id", "y", "buckets", "weights"])

    got = rows.mapInArrow(narrow, WEIGHED).orderBy(F.xxhash64("doc_id"), "doc_id").toArrow().combine_chunks()
    if not len(got):
        return Weights(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    lists = got.column("buckets").combine_chunks()
    size = np.diff(lists.offsets.to_numpy())
    weight = got.column("weights").combine_chunks().flatten().to_numpy().astype(np.float64)
    return Weights(got.column("y").to_numpy().astype(np.int64), np.repeat(np.arange(len(size)), size), lists.flatten().to_numpy().astype(np.int64), weight)


WEIGHED = "doc_id long, y int, buckets array<int>, weights array<float>"


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample: int = SAMPLE) -> Model:
    """A model from at most ``sample`` labelled rows, whole texts; a fifth of them picks the round and calibrates."""
    staged = Staged(docs.sparkSession, "toxicity")
    rows = labelled_sample(docs.select("doc_id", "text"), labels, label, sample)
    rows = staged.put(rows.select("doc_id", "y", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(bucket_rows, WEIGHED))
    fifth = F.pmod(F.xxhash64(F.lit("check"), "doc_id"), F.lit(5)) == 4
    good = telling(rows.where(~fifth))
    sets = [gathered(rows.where(~fifth), good), gathered(rows.where(fifth), good)]
    model = train(*sets)
    del sets
    give_back(docs.sparkSession)
    return model


def scorer(model) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = text_buffers(batch.column("text"))
            scores = [model.value.scores(Bag(raw, off[lo : hi + 1])) for lo, hi in chunks(off)]
            scores = np.concatenate([np.zeros(0), *scores])
            at = batch.schema.get_field_index("text")
            cols = [c for i, c in enumerate(batch.columns) if i != at]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(scores, pa.float64())], names=[n for n in batch.schema.names if n != "text"] + ["score"])

    return run


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, sample: int = SAMPLE) -> DataFrame:
    """Score every whole text; returns doc_id, held_out, score (0 to 1) and predicted (score >= threshold).

    Learns from at most ``sample`` labelled rows that are not held out; labels,
    lang, source and doc_id are never inputs of a score.

    A null or empty text, or one without letters or digits, gets the score of
    the intercept alone.  Very long texts are learnt from and scored whole.  A
    null doc_id is never held out and never labelled.  Without both labels in
    the sample every score is 0 (or 1, if all are 1).  Repeated label rows
    count once, as toxic if any says so; of rows that share a doc_id one is
    learnt from.  Repeated rows give repeated rows; an empty table an empty
    one; other columns are not read.
    """
    ship(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, "toxic", sample))
    rows = docs.select("doc_id", held_out().alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    scored = rows.mapInArrow(scorer(model), "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs`` (columns unchanged) whose text does not score ``threshold`` or more; one pass, no shuffle.

    Null, empty and very long texts, null ids, ties and repeated rows are
    scored as by ``toxicity``; an empty table stays empty.
    """
    ship(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(fit(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), labels, "toxic", sample))
    names, schema = docs.columns, docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = text_buffers(batch.column("text"))
            scores = np.concatenate([np.zeros(0), *[model.value.scores(Bag(raw, off[lo : hi + 1])) for lo, hi in chunks(off)]])
            yield batch.filter(pa.array(scores < threshold)).select(names)

    return docs.mapInArrow(run, schema)
