"""Language identification by a byte convolutional network, trained and applied in numpy.

A text's bytes are cut into windows of WINDOW bytes, the last one padded with zeros. Bytes are embedded;
filters of several widths run over a window; each filter's largest output feeds a softmax over the
languages. A document's score for a language is the mean of its windows' probabilities, weighted by
their bytes. All windows of every text are used.

Trained filters see only 256 byte values, so for application the embedding and the filters are
multiplied out into tables by byte pairs: two look-ups and one addition give all filters at a place.

The fit uses at most FIT_ROWS documents with a language outside fold 0, of at most FIT_BYTES bytes,
and FIT_WINDOWS of their windows, equal shares for all languages. Defined cases: null texts and texts without a letter are ``und``
with score 0; rows repeat as they come; without any language to learn all documents are ``und``; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import fold, map_arrow, spread, table
from .words import chunks

FIT_ROWS, FIT_BYTES, FIT_WINDOWS = 3000, 65_536, 8000
WINDOW, WIDTHS, FILTERS, EMBEDDING = 128, (2, 3, 4), 16, 8
EPOCHS, BATCH, RATE = 5, 64, 0.005
PLACES = WINDOW - max(WIDTHS) + 1
#: Shares of a language's rows in which the first ones of the sample are looked for.
DEALT = 256
#: Windows that are convolved at once.
STEP = 64


def windows(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(windows x WINDOW bytes, index of each window's text, bytes of text in it)."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    many = np.array([-(-len(b) // WINDOW) for b in raw], np.int64)
    whole = b"".join(b.ljust(int(m) * WINDOW, b"\0") for b, m in zip(raw, many, strict=True))
    owner = np.repeat(np.arange(len(raw)), many)
    begins = np.cumsum(many) - many
    nth = np.arange(len(owner)) - begins[owner]
    held = np.minimum(np.array([len(b) for b in raw], np.int64)[owner] - nth * WINDOW, WINDOW)
    return np.frombuffer(whole, np.uint8).reshape(-1, WINDOW), owner, held


class ByteConvolution:
    """Embedding, filters and output layer of the network."""

    def __init__(self, languages: list[str], seed: int = 3):
        random = np.random.default_rng(seed)
        self.languages = languages
        self.embedding = random.normal(0, 0.5, (256, EMBEDDING)).astype(np.float32)
        self.filters = [random.normal(0, 1 / np.sqrt(w * EMBEDDING), (w, EMBEDDING, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.out = random.normal(0, 0.1, (FILTERS * len(WIDTHS), len(languages))).astype(np.float32)
        self.bias = np.zeros(len(languages), np.float32)

    def fit(self, data: np.ndarray, y: np.ndarray, seed: int = 4) -> ByteConvolution:
        """Minibatch Adam on the windows' cross-entropy."""
        random = np.random.default_rng(seed)
        values = [self.embedding, *self.filters, self.out, self.bias]
        m, v = [np.zeros_like(x) for x in values], [np.zeros_like(x) for x in values]
        step = 0
        for _ in range(EPOCHS):
            for batch in np.array_split(random.permutation(len(data)), max(1, len(data) // BATCH)):
                step += 1
                for x, g, a, b in zip(values, self._gradients(data[batch], y[batch]), m, v, strict=True):
                    a += 0.1 * (g - a)
                    b += 0.001 * (g * g - b)
                    x -= RATE * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-7)
        return self

    def _gradients(self, data: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        n = len(data)
        seen = self.embedding[data]
        spans, tops, hidden = [], [], []
        for width, kernel in zip(WIDTHS, self.filters, strict=True):
            span = np.concatenate([seen[:, j : j + PLACES] for j in range(width)], axis=2)
            made = span.reshape(n * PLACES, -1) @ kernel.reshape(-1, FILTERS)
            made = made.reshape(n, PLACES, FILTERS)
            top = made.argmax(1)
            spans.append(span)
            tops.append(top)
            hidden.append(np.take_along_axis(made, top[:, None], 1)[:, 0])
        h = np.maximum(np.concatenate(hidden, 1), 0)
        p = self._softmax(h @ self.out + self.bias)
        p[np.arange(n), y] -= 1
        p /= n
        back = (p @ self.out.T) * (h > 0)
        embedding, filters = np.zeros_like(self.embedding), []
        rows = np.arange(n)[:, None]
        for i, (width, kernel) in enumerate(zip(WIDTHS, self.filters, strict=True)):
            pull = back[:, i * FILTERS : (i + 1) * FILTERS]
            chosen = spans[i][rows, tops[i]]  # texts x filters x (width x EMBEDDING)
            filters.append(np.einsum("nf,nfk->kf", pull, chosen).reshape(kernel.shape))
            for j in range(width):
                np.add.at(embedding, data[rows, tops[i] + j], pull[:, :, None] * kernel[j].T[None])
        return [embedding, *filters, h.T @ p, p.sum(0)]

    @staticmethod
    def _softmax(z: np.ndarray) -> np.ndarray:
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """Filter outputs by the byte pairs at a place and two places on, all widths side by side."""
        parts = [np.zeros((len(WIDTHS) * FILTERS, 256), np.float32) for _ in range(4)]
        for i, kernel in enumerate(self.filters):
            for j in range(kernel.shape[0]):
                parts[j][i * FILTERS : (i + 1) * FILTERS] = (self.embedding @ kernel[j]).T
        pair = lambda a, b: (a.T[:, None] + b.T[None]).reshape(256 * 256, -1)
        first, second = pair(parts[0], parts[1]), pair(parts[2], parts[3])[:, FILTERS:]  # width 2 ends with the first pair
        return np.ascontiguousarray(first), np.ascontiguousarray(second)

    def probabilities(self, data: np.ndarray, tables: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        out = np.empty((len(data), len(self.languages)), np.float32)
        for at in range(0, len(data), STEP):
            block = data[at : at + STEP].astype(np.int32)
            pairs = block[:, :-1] << 8 | block[:, 1:]
            made = tables[0].take(pairs[:, :PLACES], 0)
            made[:, :, FILTERS:] += tables[1].take(pairs[:, 2 : 2 + PLACES], 0)
            out[at : at + STEP] = self._softmax(np.maximum(made.max(1), 0) @ self.out + self.bias)
        return out


def sample(docs: DataFrame, seed: int = 7) -> list[tuple[str, str]]:
    """(text, lang) of at most FIT_ROWS documents outside fold 0, as many of each language, in the order of a hash of the id.

    The languages are those of all rows outside fold 0; each gets an equal share of the rows.
    """
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold(F.col("doc_id")) != 0))
    usable = usable.where((F.octet_length("text") <= FIT_BYTES) & F.col("text").rlike("\\p{L}"))
    names = usable.select("lang").distinct().limit(FIT_ROWS + 1).count()
    if names > FIT_ROWS:
        raise ValueError(f"more than {FIT_ROWS} languages")
    order = [F.xxhash64("doc_id", F.lit(seed)), F.col("doc_id")]
    place = F.row_number().over(Window.partitionBy("lang").orderBy(*order))
    each = FIT_ROWS // max(1, names)
    # first among the rows of each of DEALT shares of a language, so that no task orders a whole language
    dealt = usable.select("doc_id", "lang").distinct().withColumn("_share", F.pmod(F.xxhash64("doc_id", F.lit(seed + 1)), F.lit(DEALT)))
    near = F.row_number().over(Window.partitionBy("lang", "_share").orderBy(*order))
    dealt = dealt.withColumn("_near", near).where(F.col("_near") <= each)
    ids = dealt.withColumn("_place", place).where(F.col("_place") <= each).select("doc_id", "lang")
    joined = usable.join(F.broadcast(ids), ["doc_id", "lang"], "left_semi")  # at most FIT_ROWS rows
    rows = joined.orderBy("lang", *order, "text").select("text", "lang").limit(FIT_ROWS).collect()
    return [(r.text, r.lang) for r in rows]


def fit(rows: list[tuple[str, str]], seed: int = 9) -> ByteConvolution | None:
    """The network fitted on at most FIT_WINDOWS windows, an equal share of them for each language."""
    languages = sorted({lang for _, lang in rows})
    if not languages:
        return None
    data, owner, _ = windows([t for t, _ in rows])
    y = np.array([languages.index(lang) for _, lang in rows])[owner]
    mixed = np.random.default_rng(seed).permutation(len(data))
    pick = np.concatenate([mixed[y[mixed] == i][: FIT_WINDOWS // len(languages)] for i in range(len(languages))])
    return ByteConvolution(languages).fit(data[pick], y[pick])


def identify(docs: DataFrame, model: ByteConvolution | None) -> DataFrame:
    """doc_id, lang_pred, score of every document."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.coalesce(F.col("text").rlike("\\p{L}"), F.lit(False)).alias("letters"))
    if model is None:
        return rows.select("doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        tables = model.tables()
        names = np.array([*model.languages, "und"], object)
        for batch in batches:
            letters = batch.column(2).to_numpy(zero_copy_only=False)
            texts = [t if ok else "" for t, ok in zip(batch.column(1).to_pylist(), letters, strict=True)]
            total = np.zeros((len(texts), len(model.languages)))
            for part in chunks(texts):
                data, owner, held = windows(texts[part])
                if len(data):
                    np.add.at(total, owner + part.start, model.probabilities(data, tables) * held[:, None])
            mass = total.sum(1)
            share = total.max(1) / np.maximum(mass, 1e-9)
            best = np.where(letters, total.argmax(1), len(model.languages))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(names[best].tolist(), pa.string()), pa.array(np.where(letters, np.clip(share, 0, 1), 0.0))],
                names=["doc_id", "lang_pred", "score"],
            )

    return map_arrow(rows, run, "doc_id bigint, lang_pred string, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(spread(docs), fit(sample(docs))).select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "lang_pred", "score")
