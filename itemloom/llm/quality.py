"""Operator 5, a quality classifier by co-training.

One classifier sees only a text's content (its words, hashed; shares of letter
cases, marks and digits; repetition of words and lines), the other only its
metadata (source, language, stated length).  In each round both label the
unlabelled rows that they are surest of for the other one, searched among all
unlabelled rows.  At the end both are calibrated on labelled rows that neither
saw, and their logits are combined.

Whole texts are read once, into a row of figures each; rounds and scoring read
those.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import Staged
from .toxicity import held_out, labelled_sample
from .words import Words, chunks, text_buffers

#: Labelled rows used for training at most, those of smallest hash of doc_id.
SAMPLE = 4_000
ROUNDS = 4
#: Rows that a classifier labels for the other in one round, at this confidence or more.
GIVEN = 200
SURE = 0.95
BINS = 12
META = 256
#: Buckets of hashed words, and what a word's share of a text counts for.
LEXICAL = 64
WEIGHT = 10.0
#: Content figures besides the hashed words.
FIGURES = 9

_UPPER, _DIGIT, _MARK, _LINE = (np.zeros(256, dtype=bool) for _ in range(4))
_UPPER[ord("A") : ord("Z") + 1] = True
_DIGIT[ord("0") : ord("9") + 1] = True
_MARK[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True
_LINE[0x0A] = True


def content(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Content figures, one row for each text."""
    words = Words(raw, offsets)
    n_docs, size = words.n_docs, np.maximum(np.diff(words.offsets), 1)
    share = [np.diff(np.concatenate([[0], np.cumsum(kind[words.raw])])[words.offsets]) / size for kind in (_UPPER, _DIGIT, _MARK, _LINE)]
    count = np.diff(words.first)
    some = np.maximum(count, 1)
    h = words.hashes() if len(words) else np.zeros(0, np.uint64)
    after = np.zeros(len(words), dtype=bool)
    after[1:] = (h[1:] == h[:-1]) & (words.doc[1:] == words.doc[:-1])
    same = np.bincount(words.doc[after], minlength=n_docs) / some
    order = np.lexsort((h, words.doc))
    hd, dd = h[order], words.doc[order]
    first = np.ones(len(h), dtype=bool)
    first[1:] = (hd[1:] != hd[:-1]) | (dd[1:] != dd[:-1])
    different = np.bincount(dd[first], minlength=n_docs)
    length = np.bincount(words.doc, weights=words.ends - words.starts, minlength=n_docs) / some
    # different words against what a text of this length usually has
    rich = np.log1p(different) / np.log1p(some)
    figures = np.stack([*share, same, different / some, rich, length, np.log1p(count)], axis=1)
    bucket = words.doc * LEXICAL + (h % np.uint64(LEXICAL)).astype(np.int64)
    lexical = np.bincount(bucket, minlength=n_docs * LEXICAL).reshape(n_docs, LEXICAL) / some[:, None]
    return np.concatenate([figures, WEIGHT * lexical], axis=1).astype(np.float32)


def metadata(source: list, lang: list, n_chars: list) -> np.ndarray:
    """Hashed places of source, language and length, one row for each document."""
    import zlib

    out = np.zeros((len(source), 3), dtype=np.int32)
    for i, (s, g, n) in enumerate(zip(source, lang, n_chars, strict=True)):
        out[i] = [zlib.crc32(x.encode()) % META for x in (f"s{s}", f"l{g}", f"n{-1 if n is None else int(n).bit_length()}")]
    return out


def indicators(places: np.ndarray) -> np.ndarray:
    out = np.zeros((len(places), META))
    for j in range(places.shape[1]):
        out[np.arange(len(places)), places[:, j]] += 1
    return out


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1.0, steps: int = 25) -> np.ndarray:
    """Weights with the intercept last; Newton's method with an L2 penalty."""
    x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    w = np.zeros(x.shape[1])
    ridge = np.full(len(w), penalty)
    ridge[-1] = 1e-3
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (p - y) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


@dataclass
class View:
    """A classifier of one view: figures in quantile bins (edges) or as they are, and logistic weights."""

    edges: list[np.ndarray] | None
    weights: np.ndarray

    def spread(self, x: np.ndarray) -> np.ndarray:
        if self.edges is None:
            return indicators(x)
        cols = [x[:, len(self.edges) :]]
        for j, e in enumerate(self.edges):
            cols.append((np.searchsorted(e, x[:, j], side="right")[:, None] == np.arange(len(e) + 1)[None, :]).astype(float))
        return np.concatenate(cols, axis=1)

    def logits(self, x: np.ndarray) -> np.ndarray:
        return self.spread(x) @ self.weights[:-1] + self.weights[-1]

    def fit(self, x: np.ndarray, y: np.ndarray) -> None:
        self.weights = logistic(self.spread(x), y)


@dataclass
class CoTrained:
    views: list[View]
    blend: np.ndarray

    def scores(self, xs: list[np.ndarray]) -> np.ndarray:
        z = np.stack([v.logits(x) for v, x in zip(self.views, xs, strict=True)], axis=1)
        return 1 / (1 + np.exp(-np.clip(z @ self.blend[:-1] + self.blend[-1], -50, 50)))


    def sure(self, xs: list[np.ndarray], v: int) -> np.ndarray:
        """How likely view v holds quality 1 to be."""
        return 1 / (1 + np.exp(-np.clip(self.views[v].logits(xs[v]), -50, 50)))


def read(table: pa.Table | pa.RecordBatch) -> list[np.ndarray]:
    """Both views of rows of figures."""
    out = []
    for name, width, kind in (("content", FIGURES + LEXICAL, np.float64), ("meta", 3, np.int64)):
        col = table.column(name)
        col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
        out.append(col.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(-1, width))
    return out


def surest(pool: DataFrame, model: CoTrained, v: int, taken: set[int]) -> pa.Table:
    """The ``GIVEN`` rows of the whole pool that view v is surest of, with its labels as y."""
    sent = pool.sparkSession.sparkContext.broadcast((model, np.array(sorted(taken), dtype=np.int64)))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            model, gone = sent.value
            p = model.sure(read(batch), v)
            keep = (np.maximum(p, 1 - p) >= SURE) & ~np.isin(batch.column("doc_id").to_numpy(), gone)
            cols = [*batch.columns, pa.array(np.maximum(p, 1 - p)), pa.array((p >= 0.5).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(cols, names=[*batch.schema.names, "sureness", "y"]).filter(pa.array(keep))

    found = pool.mapInArrow(score, f"{ROW}, sureness double, y int")
    return found.orderBy(F.desc("sureness"), F.xxhash64("doc_id"), "doc_id").limit(GIVEN).toArrow()


def cotrain(xs: list[np.ndarray], y: np.ndarray, pool: DataFrame, rounds: int = ROUNDS) -> CoTrained:
    """Both views trained from labelled rows (xs, y) and all unlabelled ones (pool)."""
    steps = np.linspace(0, 1, BINS + 1)[1:-1]
    edges = [np.unique(np.quantile(xs[0][:, j], steps)) if len(y) else np.zeros(0) for j in range(FIGURES)]
    views = [View(edges, np.zeros(sum(len(e) + 1 for e in edges) + LEXICAL + 1)), View(None, np.zeros(META + 1))]
    if len(np.unique(y)) < 2:
        only = 50.0 if len(y) and y[0] == 1 else -50.0
        return CoTrained(views, np.array([0.0, 0.0, only]))
    check = np.arange(len(y)) % 4 == 3
    given = [([xs[v][~check]], [y[~check]]) for v in (0, 1)]
    taken: set[int] = set()
    for r in range(rounds + 1):
        for v in (0, 1):
            views[v].fit(np.concatenate(given[v][0]), np.concatenate(given[v][1]))
        for v in (0, 1) if r < rounds else ():
            got = surest(pool, CoTrained(views, np.zeros(3)), v, taken)
            given[1 - v][0].append(read(got)[1 - v])
            given[1 - v][1].append(got.column("y").to_numpy().astype(np.int64))
            taken |= set(got.column("doc_id").to_pylist())
    z = np.stack([views[v].logits(xs[v][check]) for v in (0, 1)], axis=1)
    scale = [logistic(z[:, v : v + 1], y[check], 0.1) for v in (0, 1)]
    calm = np.stack([z[:, v] * scale[v][0] + scale[v][1] for v in (0, 1)], axis=1)
    top = logistic(calm, y[check], 0.1)
    blend = np.array([top[0] * scale[0][0], top[1] * scale[1][0], top[2] + top[0] * scale[0][1] + top[1] * scale[1][1]])
    return CoTrained(views, blend)


ROW = "doc_id long, held_out boolean, content array<float>, meta array<int>"


def figures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, off = text_buffers(batch.column("text"))
        texts = np.concatenate([np.zeros((0, FIGURES + LEXICAL), np.float32), *[content(raw, off[lo : hi + 1]) for lo, hi in chunks(off)]])
        places = metadata(*[batch.column(c).to_pylist() for c in ("source", "lang", "n_chars")])
        arrays = [pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel())) for x in (texts, places)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), *arrays], names=["doc_id", "held_out", "content", "meta"])


def fit_quality(rows: DataFrame, labels: DataFrame, sample: int = SAMPLE, staged: Staged | None = None) -> CoTrained:
    """From rows of figures; ``staged`` keeps the unlabelled ones, so that they are told apart once and not in every round."""
    known = labelled_sample(rows, labels, "quality", sample).orderBy(F.xxhash64("doc_id"), "doc_id", F.hash("content")).toArrow()
    named = labels.select("doc_id").where("doc_id is not null").distinct()
    pool = rows.where("doc_id is not null").join(named, "doc_id", "left_anti").select(*rows.columns)
    pool = staged.put(pool) if staged else pool
    return cotrain(read(known), np.array(known.column("y").to_pylist(), dtype=np.int64), pool)


def quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Score every whole document; returns doc_id, held_out, score (higher: quality 1 likelier) and predicted.

    Labels of rows with crc32(doc_id) % 3 = 1 are never learnt from.  Trained
    on at most ``SAMPLE`` labelled rows; unlabelled rows all take part.

    A null or empty text has no words and is scored by its other figures all
    the same; a very long one is read whole.  Null source, lang or n_chars are
    values of their own.  A null doc_id is never held out nor learnt from.
    Without both labels every score is 0 (or 1).  Repeated label rows count
    once.  Repeated rows give repeated rows, an empty table an empty one;
    further columns are not read.
    """
    staged = Staged(docs.sparkSession, "quality")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.col("n_chars").cast("long").alias("n_chars"))
    rows = staged.put(docs.withColumn("held_out", held_out()).mapInArrow(figures, ROW))
    model = docs.sparkSession.sparkContext.broadcast(fit_quality(rows, labels, staged=staged))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(model.value.scores(read(batch)), pa.float64())], names=["doc_id", "held_out", "score"])

    scored = rows.mapInArrow(score, "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
