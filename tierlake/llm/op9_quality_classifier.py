"""Quality classifier: random-indexing word vectors pooled per document, a two-layer numpy network, temperature-calibrated probabilities.

Tokens are runs of letters and digits (A-Z lower-cased) and runs of other
printable bytes, hashed to BUCKETS rows. In random indexing every context, here
a training document, has a fixed sparse ternary vector, and a token's vector is
the sum of its contexts' vectors, scaled to unit length. A document is the mean
of its tokens' vectors. Because pooling is linear, the first layer is applied
to the token table once, and scoring is a table look-up and a sum.

The fit uses a bounded sample: at most TRAIN_ROWS labelled documents of at most
TRAIN_BYTES each, those with the least hash of doc_id, and only rows whose
crc32(doc_id as text) mod 3 is not 1. A fifth of them is left out of the
training and sets the temperature. Scoring covers every whole text.

Defined cases: null or empty text, or white space alone: score 0.0. No label,
or one class alone: the share of label 1 (0.5 without labels) for all others.
Null labels are ignored; a doc_id with several labels counts as its greatest.
Repeated rows are scored each. A null doc_id is scored like any, and not held
out. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import conf_text_batches, longs, slices, span_hashes, table

BUCKETS_LOG2 = 15
DIMENSIONS = 64
NONZERO = 8
HIDDEN = 16
TRAIN_ROWS = 6_000
TRAIN_BYTES = 60_000
STEPS = 400
#: The token that stands for a word that has just stood there, one or two tokens before.
AGAIN = 0

#: 0: white space and control bytes; 1: letters, digits and the bytes of other scripts; 2: the rest.
_KIND = np.full(256, 2, np.uint8)
_KIND[:33] = 0
_KIND[127] = 0
_KIND[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def tokens(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the tokens, each document's first token (with the end last), and the lower-cased bytes."""
    low = _LOWER[data]
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64), low
    kind = _KIND[data]
    new = np.ones(len(data) + 1, bool)
    new[1:-1] = kind[1:] != kind[:-1]
    new[offs] = True
    edges = np.flatnonzero(new)
    starts, ends = edges[:-1], edges[1:]
    keep = kind[starts] > 0
    starts, ends = starts[keep], ends[keep]
    return starts, ends, np.searchsorted(starts, offs), low


def buckets(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, first, low = tokens(data, offs)
    hashes = span_hashes(low, starts, ends, 9)
    got = (hashes >> np.uint64(64 - BUCKETS_LOG2)).astype(np.int32)
    if len(got):
        place = np.arange(len(got)) - np.repeat(first[:-1], np.diff(first))
        again = np.zeros(len(got), bool)
        for back in (1, 2):
            again[back:] |= (hashes[back:] == hashes[:-back]) & (place[back:] >= back)
        got[again & (_KIND[data[starts]] == 1)] = AGAIN
    return got, first


COUNTS = pa.schema([("doc_id", pa.int64()), ("quality", pa.int32()), ("ids", pa.binary()), ("counts", pa.binary())])


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, data, offs in slices(batches, "text"):
        got, first = buckets(data, offs)
        own = [np.unique(got[a:b], return_counts=True) for a, b in zip(first[:-1], first[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([k.astype("<i4").tobytes() for k, _ in own], pa.binary()), pa.array([n.astype("<i4").tobytes() for _, n in own], pa.binary())], schema=COUNTS)


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, size: int = TRAIN_BYTES) -> DataFrame:
    """The bounded training sample: doc_id, quality, text."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("doc_id is not null and quality is not null")
    known = known.where(~held_out()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    fit = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text")).where(F.octet_length("text") <= size)
    ids = known.join(fit.select("doc_id").distinct(), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    return fit.join(F.broadcast(ids), "doc_id").select("doc_id", "quality", "text")


class Model:
    """first: bucket -> hidden layer's sums (unit word vectors times the first layer)."""

    def __init__(self, first=None, b1=None, w2=None, b2=0.0, temperature=1.0, constant=None):
        self.first, self.b1, self.w2, self.b2, self.temperature, self.constant = first, b1, w2, b2, temperature, constant

    def score(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        got, first = buckets(data, offs)
        n = np.diff(first)
        if self.constant is not None:
            return np.where(n > 0, self.constant, 0.0)
        full = np.flatnonzero(n)
        out = np.zeros(len(n))
        if len(full):
            sums = np.add.reduceat(self.first[got], first[:-1][full], axis=0)
            hidden = np.tanh(sums / n[full, None] + self.b1)
            out[full] = 1 / (1 + np.exp(-(hidden @ self.w2 + self.b2) / self.temperature))
        return out


def _contexts(doc_ids: np.ndarray) -> np.ndarray:
    """The documents' index vectors: NONZERO entries of +1 or -1, given by doc_id alone."""
    out = np.zeros((len(doc_ids), DIMENSIONS), np.float32)
    for i, d in enumerate(doc_ids):
        rng = np.random.default_rng([7, int(d) & (2**63 - 1)])
        out[i, rng.choice(DIMENSIONS, NONZERO, replace=False)] = rng.choice([-1, 1], NONZERO)
    return out


def train(rows: list) -> Model:
    """rows: (doc_id, quality, bucket ids, counts) of the bounded sample."""
    rows = sorted(rows, key=lambda r: r[0])
    y = np.array([float(r[1] > 0) for r in rows])
    if not len(y) or y.min() == y.max():
        return Model(constant=float(y.mean()) if len(y) else 0.5)
    ids = [np.frombuffer(r[2], "<i4") for r in rows]
    n = [np.frombuffer(r[3], "<i4").astype(np.float32) for r in rows]
    contexts = _contexts(np.array([r[0] for r in rows]))
    vectors = np.zeros((1 << BUCKETS_LOG2, DIMENSIONS), np.float32)
    for k, c, context in zip(ids, n, contexts, strict=True):
        vectors[k] += np.log1p(c)[:, None] * context
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-6)
    x = np.stack([(c @ vectors[k]) / max(1.0, c.sum()) for k, c in zip(ids, n, strict=True)]).astype(np.float64)
    mean, scale = x.mean(0), x.std(0) + 1e-6
    x = (x - mean) / scale
    left = np.arange(len(y)) % 5 == 4
    if len(set(y[left])) < 2 or len(set(y[~left])) < 2:  # too few rows to leave some out
        left[:] = False
    xt, yt = x[~left], y[~left]
    rng = np.random.default_rng(3)
    w1, b1, w2, b2 = rng.normal(0, 0.2, (DIMENSIONS, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 0.2, HIDDEN), np.zeros(1)
    params = [w1, b1, w2, b2]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, STEPS + 1):
        h = np.tanh(xt @ w1 + b1)
        p = 1 / (1 + np.exp(-(h @ w2 + b2)))
        d = (p - yt) / len(yt)
        dh = np.outer(d, w2) * (1 - h * h)
        grads = [xt.T @ dh + 1e-4 * w1, dh.sum(0), h.T @ d + 1e-4 * w2, np.array([d.sum()])]
        for q, g, a, b in zip(params, grads, m, v, strict=True):
            a += 0.1 * (g - a)
            b += 0.001 * (g * g - b)
            q -= 0.02 * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
    at = left if left.any() else ~left
    logits = np.tanh(x[at] @ w1 + b1) @ w2 + b2
    grid = np.geomspace(0.25, 8, 61)
    loss = [np.mean(np.logaddexp(0, -(2 * y[at] - 1) * logits / t)) for t in grid]
    layer = w1 / scale[:, None]
    return Model((vectors @ layer).astype(np.float32), b1 - mean @ layer, w2, float(b2[0]), float(grid[int(np.argmin(loss))]))


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    rows = sample(docs, labels).select("doc_id", "quality", "text").mapInArrow(_counts, "doc_id long, quality int, ids binary, counts binary").collect()
    return train(rows)


SCORES = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])


def _score(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for batch, data, offs in slices(batches, "text"):
        yield pa.RecordBatch.from_arrays([pa.array(longs(batch, "doc_id")) if not batch.column(0).null_count else batch.column(0).cast(pa.int64()), pa.array(model.score(data, offs))], schema=SCORES)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score."""
    conf_text_batches(docs.sparkSession)
    own = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))
    return own.mapInArrow(lambda it: _score(it, model), "doc_id long, score double")


def keep_good(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    """The rows, all their columns, that the model doesn't reject."""
    for batch, data, offs in slices(batches, "text"):
        yield batch.filter(pa.array(model.score(data, offs) >= 0.5))


def filter_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents with a score of at least 0.5, all columns as they are."""
    conf_text_batches(docs.sparkSession)
    model = fit(docs, labels)
    return docs.mapInArrow(lambda it: keep_good(it, model), docs.schema)


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    conf_text_batches(spark)
    out = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
