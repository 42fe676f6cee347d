"""Toxicity by multiple-instance learning: documents are bags of sentences.

A sentence's score is a logistic function of the weights of its words and of their first four and
five letters, so inflected forms of a stem count alike; a document's score is the
noisy-or of its sentences' scores, 1 - prod(1 - p). Only documents have labels: the likelihood of a
document is differentiated through the noisy-or down to its sentences, so the fit itself finds which
sentences make a document toxic, and the same scores locate them.

The fit uses at most FIT_ROWS labelled documents of at most FIT_BYTES bytes outside fold 0, and
the features that occur in at least MIN_DOCS of them. Every document is scored over its whole text.

Defined cases: null and empty texts have no sentence and score 0; rows repeat as they come; without
a label the model scores 0 everywhere; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, labelled_sample, map_arrow, spread, table

FIT_ROWS, FIT_BYTES, MIN_DOCS, MAX_FEATURES = 2400, 32_768, 5, 50_000
STEPS, RATE, PENALTY, START = 80, 0.25, 1e-4, -8.0
#: Words whose weights a worker keeps.
REMEMBERED = 300_000
_SENTENCE = re.compile(r"[^.!?\n]+[.!?]*")
_WORD = re.compile(r"\w+")


def sentences(text: str) -> list[tuple[int, int]]:
    """(start, end) of the sentences of a text; ends are . ! ? and line breaks."""
    return [m.span() for m in _SENTENCE.finditer(text)]


def parts(word: str) -> list[int]:
    """A word's features, by their crc32: itself and its beginnings."""
    return [zlib.crc32(f.encode("utf-8", "surrogatepass")) for f in (word, *(f"{word[:n]}-" for n in (4, 5) if len(word) >= n))]


class Parts(dict):
    """word -> its features, computed on first use."""

    def __missing__(self, word: str) -> list[int]:
        if len(self) >= REMEMBERED // 8:
            self.clear()
        value = self[word] = parts(word)
        return value


class Weights(dict):
    """word -> sum of its features' weights, computed on first use; features the fit didn't keep weigh nothing."""

    def __init__(self, features: dict[int, float]):
        super().__init__()
        self.features = features

    def __missing__(self, word: str) -> float:
        if len(self) >= REMEMBERED:
            self.clear()
        value = self[word] = sum(self.features.get(f, 0.0) for f in parts(word))
        return value

    def __reduce__(self):
        return Weights, (self.features,)


class NoisyOr:
    """The fitted model."""

    def __init__(self, weights: dict[int, float], bias: float):
        self.weights, self.bias = Weights(weights), bias

    def sentence_scores(self, text: str) -> tuple[list[tuple[int, int]], np.ndarray]:
        lower = text.lower()
        if len(lower) != len(text):  # a few letters grow when lowered; spans stay those of the text
            lower = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        spans, get = sentences(lower), self.weights.__getitem__
        z = np.array([sum(map(get, {*_WORD.findall(lower, a, b)})) for a, b in spans], np.float64) + self.bias
        return spans, 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def score(self, text: str) -> tuple[float, list[tuple[int, int, float]]]:
        """Document score, and (start, end, score) of the sentences at or above one half."""
        spans, p = self.sentence_scores(text)
        if not len(p):
            return 0.0, []
        total = float(-np.expm1(np.log1p(-np.minimum(p, 1 - 1e-12)).sum()))
        return total, [(*spans[i], float(p[i])) for i in np.flatnonzero(p >= 0.5)]


def fit(sample: list[tuple[str, int]]) -> NoisyOr:
    """Full-batch Adam on the documents' negative log-likelihood."""
    known, held, rows, owner = Parts(), [], [], []
    for d, text in enumerate(t.lower() for t, _ in sample):
        bags = [{f for w in {*_WORD.findall(text, a, b)} for f in known[w]} for a, b in sentences(text)]
        held.append(np.fromiter((f for bag in bags for f in bag), np.uint32))
        rows.append(np.repeat(np.arange(len(bags), dtype=np.int32), [len(bag) for bag in bags]) + len(owner))
        owner += [d] * len(bags)
    del known
    found, seen = np.unique(np.concatenate([np.unique(h) for h in held] or [np.zeros(0, np.uint32)]), return_counts=True)
    order = np.argsort(-seen, kind="stable")[:MAX_FEATURES]
    names = np.sort(found[order[seen[order] >= MIN_DOCS]])
    if not any(y for _, y in sample) or not len(names):
        return NoisyOr({}, -30.0)
    entry, row = np.concatenate(held), np.concatenate(rows)
    del held, rows
    column = np.minimum(np.searchsorted(names, entry), len(names) - 1).astype(np.int32)
    usable = names[column] == entry
    column, row, owner = column[usable], row[usable], np.array(owner, np.int32)
    y = np.array([v for _, v in sample], np.float64)
    # both labels have half of the loss, whatever their shares in the sample, so a score means the same at every size
    weight = 0.5 / np.where(y > 0, y.mean(), 1 - y.mean()) / len(y)
    theta, m, v = (np.zeros(len(names) + 1) for _ in range(3))
    theta[-1] = START
    for step in range(1, STEPS + 1):
        z = np.bincount(row, theta[column], len(owner)) + theta[-1]
        p = np.clip(1 / (1 + np.exp(-np.clip(z, -30, 30))), 1e-12, 1 - 1e-12)
        none = np.exp(np.bincount(owner, np.log1p(-p), len(y)))  # probability that no sentence is toxic
        pull = np.where(y > 0, -none / np.maximum(1 - none, 1e-9), 1.0)[owner] * p * weight[owner]
        gradient = np.append(np.bincount(column, pull[row], len(names)), pull.sum())
        gradient[:-1] += PENALTY * theta[:-1]
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
        theta -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return NoisyOr({f: float(x) for f, x in zip(names.tolist(), theta[:-1], strict=True) if abs(x) > 1e-6}, float(theta[-1]))


def score(docs: DataFrame, model: NoisyOr) -> DataFrame:
    """doc_id, score, n_sentences, offending array of (start, end, score) in code points."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most MAX_FEATURES weights
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            found = [model.score(t or "") for t in batch.column(1).to_pylist()]
            spans = [[{"start": a, "end": b, "score": p} for a, b, p in s] for _, s in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([p for p, _ in found], pa.float64()), pa.array(spans, kind)], names=["doc_id", "score", "offending"]
            )

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return map_arrow(rows, run, "doc_id bigint, score double, offending array<struct<start:int,end:int,score:double>>")


def fitted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> NoisyOr:
    return fit(labelled_sample(docs, table(spark, sf_dir, "labels"), "toxic", FIT_ROWS, FIT_BYTES))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents scored at or above one half go."""
    shared = spark.sparkContext.broadcast(fitted(spark, docs, sf_dir))
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [shared.value.score(t or "")[0] < 0.5 for t in batch.column(place).to_pylist()]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return map_arrow(spread(docs), run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(spread(docs), fitted(spark, docs, sf_dir)).select(
        "doc_id",
        (fold(F.col("doc_id")) == 0).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        "offending",
    )
