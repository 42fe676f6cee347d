"""Quality scores by a factorisation machine.

A document is a sparse vector of its hashed words (shares of its words), statistics of its structure
and its metadata (length). The machine adds to a linear model a low-rank weight for each pair of
features; by the identity sum_{i<j} <v_i, v_j> x_i x_j = (|sum v_i x_i|^2 - sum |v_i|^2 x_i^2) / 2
a score takes time linear in the number of features.

The fit uses at most FIT_ROWS labelled documents of at most FIT_BYTES bytes outside fold 0; labels,
lang, source and doc_id are no features. Defined cases: null and empty texts have only structure
features and get a score like any other; rows repeat as they come; without a label every score is
one half; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, labelled_sample, map_arrow, spread, table
from .words import chunks, word_spans

FIT_ROWS, FIT_BYTES = 4000, 65_536
BUCKETS, RANK, EPOCHS, BATCH, RATE, PENALTY = 1 << 14, 8, 12, 64, 0.01, 1e-5
THRESHOLD = 0.3
#: Byte classes of the structure statistics.
_CLASSES = np.zeros((256, 6), np.float32)
_CLASSES[65:91, 0] = 1  # capitals
_CLASSES[48:58, 1] = 1  # digits
_CLASSES[[ord(c) for c in "!?"], 2] = 1
_CLASSES[[ord(c) for c in "#$%&*@^~=+<>\\_"], 3] = 1
_CLASSES[[ord(c) for c in "|/{}[]();:"], 4] = 1
_CLASSES[10, 5] = 1  # line breaks
N_STATS = _CLASSES.shape[1] + 5


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, feature, value) sorted by text; features from BUCKETS on are statistics and metadata."""
    n = len(texts)
    buffer, start, end, hashes, owner = word_spans(texts)
    sizes = np.array([len(t.encode("utf-8", "surrogatepass")) for t in texts], np.int64)
    begins = np.cumsum(np.append(0, sizes + 1))[:-1]
    words = np.bincount(owner, minlength=n)
    keys = owner * BUCKETS + (hashes & np.uint64(BUCKETS - 1)).astype(np.int64)
    found, count = np.unique(keys, return_counts=True)
    text, bucket = found // BUCKETS, found % BUCKETS
    shares = count / words[text]
    classes = np.add.reduceat(_CLASSES[buffer], begins, axis=0) / np.maximum(sizes, 1)[:, None]
    lengths = np.bincount(owner, end - start, n)
    distinct = np.bincount(np.unique(np.stack([owner.astype(np.uint64), hashes]), axis=1)[0].astype(np.int64), minlength=n) if len(hashes) else words
    chars = np.array([len(t) for t in texts], np.float64)
    stats = np.column_stack(
        [
            np.sqrt(classes),
            lengths / np.maximum(words, 1) / 10,
            distinct / np.maximum(words, 1),
            np.log1p(chars) / 10,
            (sizes - chars) / np.maximum(sizes, 1),
            np.ones(n),
        ]
    )
    text = np.concatenate([text, np.repeat(np.arange(n), N_STATS)])
    feature = np.concatenate([bucket, np.tile(np.arange(N_STATS) + BUCKETS, n)])
    value = np.concatenate([shares, stats.ravel()])
    order = np.argsort(text, kind="stable")
    return text[order], feature[order], value[order]


class FactorisationMachine:
    """bias + linear weights + RANK factors per feature."""

    def __init__(self, seed: int = 11):
        self.bias = 0.0
        self.w = np.zeros(BUCKETS + N_STATS)
        self.v = np.random.default_rng(seed).normal(0, 0.05, (BUCKETS + N_STATS, RANK))

    def raw(self, text: np.ndarray, feature: np.ndarray, value: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(score before the logistic function, sum of v x per text)."""
        first = np.searchsorted(text, np.arange(n))  # every text has its statistics
        vx = self.v[feature] * value[:, None]
        sums = np.add.reduceat(vx, first)
        squares = np.add.reduceat((vx**2).sum(1), first)
        return self.bias + np.add.reduceat(self.w[feature] * value, first) + ((sums**2).sum(1) - squares) / 2, sums

    def scores(self, texts: list[str]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(self.raw(*features(texts), len(texts))[0], -30, 30)))

    def fit(self, sample: list[tuple[str, int]], seed: int = 5) -> FactorisationMachine:
        """Minibatch Adagrad on the logistic loss, in which both labels have half of the weight."""
        if len({y for _, y in sample}) < 2:
            return self
        rows = []
        for part in chunks([t for t, _ in sample]):
            text, feature, value = features([t for t, _ in sample[part]])
            cuts = np.flatnonzero(np.diff(text)) + 1
            rows += zip(np.split(feature, cuts), np.split(value, cuts), strict=True)
        y = np.array([v for _, v in sample], np.float64)
        share = np.where(y > 0, y.mean(), 1 - y.mean())
        weight = 0.5 / share
        random = np.random.default_rng(seed)
        gw, gv, gb = np.full_like(self.w, 1e-3), np.full_like(self.v, 1e-3), 1e-3
        for _ in range(EPOCHS):
            for batch in np.array_split(random.permutation(len(rows)), max(1, len(rows) // BATCH)):
                text = np.repeat(np.arange(len(batch)), [len(rows[i][0]) for i in batch])
                feature = np.concatenate([rows[i][0] for i in batch])
                value = np.concatenate([rows[i][1] for i in batch])
                z, sums = self.raw(text, feature, value, len(batch))
                miss = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[batch]) * weight[batch] / len(batch)
                pull = (miss[text] * value)[:, None]
                dv = pull * (sums[text] - self.v[feature] * value[:, None])
                used, where = np.unique(feature, return_inverse=True)
                sw = np.bincount(where, pull[:, 0]) + PENALTY * self.w[used]
                sv = np.column_stack([np.bincount(where, dv[:, f]) for f in range(RANK)]) + PENALTY * self.v[used]
                gw[used] += sw**2
                gv[used] += sv**2
                gb += miss.sum() ** 2
                self.w[used] -= 10 * RATE * sw / np.sqrt(gw[used])
                self.v[used] -= RATE * sv / np.sqrt(gv[used])
                self.bias -= 10 * RATE * miss.sum() / np.sqrt(gb)
        return self


def score(docs: DataFrame, model: FactorisationMachine) -> DataFrame:
    """doc_id, score of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS rows of weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            parts = [shared.value.scores(texts[part]) for part in chunks(texts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate([*parts, np.zeros(0)]))], names=["doc_id", "score"])

    return map_arrow(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), run, "doc_id bigint, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    sample = labelled_sample(docs, table(spark, sf_dir, "labels"), "quality", FIT_ROWS, FIT_BYTES)
    return score(spread(docs), FactorisationMachine().fit(sample)).select(
        "doc_id",
        (fold(F.col("doc_id")) == 0).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
