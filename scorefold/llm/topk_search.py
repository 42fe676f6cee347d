"""Exact top-k search by inner product with bounds from segment statistics, coarse to fine.

A component x becomes floor(256 x). A vector is described at several resolutions: it is cut into
segments, and of each segment the mean m and the deviation s (population) are kept. For segments of w
components the sum of w ((m - m')^2 + (s - s')^2) is at most the squared distance of two vectors, at
every resolution. As d^2 = |q|^2 + |v|^2 - 2 <q, v>, a vector whose bound exceeds
|q|^2 + |v|^2 - 2 t can't reach the score t. Each query keeps its k best scores so far; t is the
least of them. Few segments are tried first, more on what they leave, and exact scores are computed
of the survivors only, so the answer is that of brute force.

Work is dealt in cells: a range of queries meets a share of the vectors. A task holds the queries of
one cell, at most about QUERIES, and streams the vectors past them, so memory is bounded and a cell
gives k rows a query. The queries of all cells are merged by a window of k rows a share.

Defined cases: vectors that are null, empty, or hold a null or non-finite component take no part.
A query meets the vectors of its own length. Rows, not ids, are told apart: a query's own row is no
candidate, another row with its id is one. Null ids are no queries; as candidates they come last in
ties. Components and scores beyond a long saturate. Empty tables give an empty result; other
columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import map_arrow, materialise, table

K, SCALE = 5, 256
#: Queries of a cell, about; they and their statistics are held by a task.
QUERIES = 16_384
#: Segments at each resolution, coarse to fine; those beyond half of the components are left out.
SEGMENTS = (4, 16, 32, 128, 512)
#: Vectors compared at once, and queries: the matrix of a step has so many entries at most.
STEP, BLOCK = 1024, 1024
#: Where more than this share of a block survives, the next resolution takes it whole as a matrix product.
DENSE = 0.1
LOW, HIGH = np.iinfo(np.int64).min, np.iinfo(np.int64).max
ENCODED = "row bigint, id bigint, dim int, vector binary, asks boolean"
FOUND = "row bigint, query_id bigint, vec_id bigint, score bigint"


def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, id, vector, asks) to ENCODED: 16-bit components where they fit, else 64-bit ones; unusable vectors are dropped."""
    for batch in batches:
        vectors = batch.column(2)
        kept, dims, data = [], [], []
        for i, values in enumerate(vectors):
            if not values.is_valid:
                continue
            values = values.values
            if not len(values) or values.null_count:
                continue
            x = np.asarray(values).astype(np.float64)
            if not np.isfinite(x).all():
                continue
            with np.errstate(over="ignore"):
                x = np.floor(SCALE * x)
            small = np.abs(x).max() < 2**15
            whole = x.astype("<i2") if small else np.where(x >= 2.0**63, HIGH, np.where(x < -(2.0**63), LOW, np.clip(x, -(2.0**63), 2.0**63 - 1024).astype("<i8")))
            kept.append(i)
            dims.append(len(x))
            data.append(whole.tobytes())
        rows = batch.take(pa.array(kept, pa.int64()))
        columns = [rows.column(0), rows.column(1), pa.array(dims, pa.int32()), pa.array(data, pa.binary()), rows.column(3)]
        yield pa.RecordBatch.from_arrays(columns, names=["row", "id", "dim", "vector", "asks"])


def decode(data: list[bytes], dim: int) -> np.ndarray:
    """Vectors as rows of float64 where these hold all components exactly, else of Python integers."""
    if all(len(d) == 2 * dim for d in data):
        return np.frombuffer(b"".join(data), "<i2").reshape(len(data), dim).astype(np.float64)
    whole = np.stack([np.frombuffer(d, "<i2" if len(d) == 2 * dim else "<i8").astype(np.int64) for d in data])
    return whole.astype(np.float64) if (whole < 2**53).all() and (whole > -(2**53)).all() else whole.astype(object)


class Statistics:
    """Vectors with their segment means and deviations, each scaled by the root of its segment's length, per resolution."""

    def __init__(self, vectors: np.ndarray):
        self.vectors = vectors
        x = vectors.astype(np.float64)
        dim = x.shape[1]
        self.square = np.einsum("ij,ij->i", x, x)
        self.levels = []
        for n in SEGMENTS:
            if 2 * n > dim:
                break
            edges = np.arange(n) * dim // n
            width = np.diff(np.append(edges, dim))
            mean = np.add.reduceat(x, edges, axis=1) / width
            centred = x - np.repeat(mean, width, axis=1)
            spread = np.add.reduceat(centred * centred, edges, axis=1)  # width times the variance
            self.levels.append(np.hstack([mean * np.sqrt(width), np.sqrt(spread)]))


def products(a: np.ndarray, b: np.ndarray, i: np.ndarray | None, j: np.ndarray | None) -> np.ndarray:
    """Inner products of all rows of ``a`` with all of ``b``, or of the rows ``i`` with the rows ``j``."""
    return a @ b.T if i is None else np.concatenate([np.empty(0), *[np.einsum("ij,ij->i", a[i[s : s + 65_536]], b[j[s : s + 65_536]]) for s in range(0, len(i), 65_536)]])


def exact(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Integer inner products of the rows ``i`` of ``a`` with the rows ``j`` of ``b``."""
    if a.dtype != object and b.dtype != object and a.shape[1] * np.abs(a).max(initial=0) * np.abs(b).max(initial=0) < 2.0**53:
        if len(i) > DENSE * len(a) * len(b):
            return (a @ b.T)[i, j].astype(np.int64)
        return products(a, b, i, j).astype(np.int64)
    whole = lambda x: np.array([[int(v) for v in row] for row in x], object)
    a, b = whole(a), whole(b)
    return np.array([min(max(int(a[x] @ b[y]), LOW + 1), HIGH) for x, y in zip(i, j, strict=True)], np.int64)


class Range:
    """The queries of a cell and the k best candidates of each so far."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int):
        self.rows, self.ids, self.k = rows, ids, k
        self.blocks = [(b, Statistics(vectors[b : b + BLOCK])) for b in range(0, len(rows), BLOCK)]
        self.score = np.full((len(rows), k), LOW)
        self.id = np.full((len(rows), k), HIGH)
        self.row = np.full((len(rows), k), -1)
        self.seen = 0

    def feed(self, rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray) -> None:
        """Vectors that all queries meet; null ids are HIGH. The first steps are short, so limits are known early."""
        at = 0
        while at < len(rows):
            step = min(STEP, max(64, self.seen))
            part = slice(at, at + step)
            one = Statistics(vectors[part])
            for begin, block in self.blocks:
                self._meet(begin, block, rows[part], ids[part], one)
            self.seen += step
            at += step

    def _meet(self, begin: int, block: Statistics, rows: np.ndarray, ids: np.ndarray, one: Statistics) -> None:
        span = slice(begin, begin + len(block.square))
        least = self.score[span, -1].astype(np.float64)
        room = 1e-9 * np.sqrt(block.square.max() * one.square.max()) + 1  # rounding of the statistics
        total = block.square[:, None] + one.square
        limit = total - 2 * (least[:, None] - room)  # squared distance at which the score is the least one
        i = j = None
        for a, b in zip(block.levels, one.levels, strict=True):
            if i is None:
                near = total - 2 * products(a, b, None, None) <= limit
                if near.mean() <= DENSE:
                    i, j = np.nonzero(near)
            else:
                near = total[i, j] - 2 * products(a, b, i, j) <= limit[i, j]
                i, j = i[near], j[near]
        if i is None:
            i, j = np.nonzero(near) if block.levels else np.nonzero(np.ones(total.shape, bool))
        score = exact(block.vectors, one.vectors, i, j)
        kept = (score >= self.score[begin + i, -1]) & (self.rows[begin + i] != rows[j])
        i, j, score = begin + i[kept], j[kept], score[kept]
        touched = np.unique(i)
        who = np.concatenate([np.repeat(touched, self.k), i])
        score = np.concatenate([self.score[touched].ravel(), score])
        ids = np.concatenate([self.id[touched].ravel(), ids[j]])
        rows = np.concatenate([self.row[touched].ravel(), rows[j]])
        order = np.lexsort((rows, ids, rows < 0, ~score, who))
        who = who[order]
        first = np.searchsorted(who, touched)
        best = order[(first[:, None] + np.arange(self.k)).ravel()]
        for mine, all_of in ((self.score, score), (self.id, ids), (self.row, rows)):
            mine[touched] = all_of[best].reshape(-1, self.k)

    def found(self) -> pa.RecordBatch:
        i, j = np.nonzero(self.row >= 0)
        ids = self.id[i, j]
        columns = [pa.array(self.rows[i]), pa.array(self.ids[i]), pa.array(ids, mask=ids == HIGH), pa.array(self.score[i, j])]
        return pa.RecordBatch.from_arrays(columns, names=["row", "query_id", "vec_id", "score"])


def search(k: int):
    """Rows sorted by (dim, range, share, kind), queries (kind 0) before vectors, to FOUND."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, queries, held = None, [], None
        for batch in batches:
            keys = np.stack([np.asarray(batch.column(c)) for c in ("dim", "range", "share", "kind")])
            edges = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1), batch.num_rows]
            for low, high in zip(edges[:-1], edges[1:], strict=True):
                if low == high:
                    continue
                *here, kind = keys[:, low].tolist()
                if here != cell:
                    if held:
                        yield held.found()
                    cell, queries, held = here, [], None
                part = batch.slice(low, high - low)
                rows = np.asarray(part.column("row"))
                ids = np.asarray(part.column("id").fill_null(int(HIGH)))
                vectors = decode(part.column("vector").to_pylist(), here[0])
                if kind == 0:
                    queries.append((rows, ids, vectors))
                elif queries:
                    held = held or Range(*(np.concatenate(x) for x in zip(*queries, strict=True)), k)
                    held.feed(rows, ids, vectors)
        if held:
            yield held.found()

    return run


def top_k(rows: DataFrame, key: str, vector: str, asks: Column, k: int = K, queries: int = QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` rows of highest score for each row for which ``asks`` holds."""
    spark = rows.sparkSession
    asked = F.coalesce(asks & F.col(key).isNotNull(), F.lit(False))
    plain = rows.select(F.monotonically_increasing_id().alias("row"), F.col(key).cast("bigint").alias("id"), F.col(vector).alias("vector"), asked.alias("asks"))
    known = materialise(map_arrow(plain, encode, ENCODED), "search-vectors")
    count = known.agg(F.count(F.lit(1)).alias("all"), F.count_if("asks").alias("asked")).first()
    ranges = max(1, -(-count["asked"] // queries))
    shares = max(1, min(-(-4 * spark.sparkContext.defaultParallelism // ranges), count["all"] // 2048))
    dealt = lambda n, seed: F.pmod(F.xxhash64("row", F.lit(seed)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asking = known.where("asks").select("row", "id", "dim", "vector", dealt(ranges, 1).alias("range"), every(shares).alias("share"), F.lit(0).alias("kind"))
    met = known.select("row", "id", "dim", "vector", every(ranges).alias("range"), dealt(shares, 2).alias("share"), F.lit(1).alias("kind"))
    cells = asking.unionByName(met).repartition(ranges * shares, "dim", "range", "share").sortWithinPartitions("dim", "range", "share", "kind")
    found = map_arrow(cells, search(k), FOUND)
    best = Window.partitionBy("row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", F.col("vec_id") % 50 == 0)


ORACLE_SQL = """
WITH v AS (
    SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS w
    FROM embeddings
    WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
    SELECT q.r, q.vec_id AS query_id, c.vec_id, list_inner_product(q.w, c.w)::BIGINT AS score
    FROM v q JOIN v c ON q.r <> c.r AND len(q.w) = len(c.w)
    WHERE q.vec_id % 50 = 0
)
SELECT query_id, (row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST))::INTEGER AS rank, vec_id, score
FROM s QUALIFY rank <= 5
"""
