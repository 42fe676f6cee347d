"""Audit of how filters overlap, in every order, from packed bitmap indexes.

Five filters look at whole texts. Each task packs the rows of its partition into NumPy bitsets: one for
each filter, one for each label, and for each part a run of whole bytes that holds the part's rows
(pad bits are off in a bitset of the rows). For each of the 32 sets of filters the rows that no filter of
the set stops are the AND-NOT of its bitsets; popcounts, added over the bytes of a part, say how many
rows, good rows and toxic rows are left. Those counts are summed over partitions. Any step of any
order is a difference of two of them: filter f after the prefix P removes kept(P) - kept(P + f).

Filter E needs the whole table: a text's digest (SHA-256) is counted with its smallest doc_id, and
rows look their digest up. Digests that hold over a thousandth of the rows, a thousand at most, are
broadcast; their rows join nothing else, so no copies meet in one task. Ids likewise for labels.

Defined cases: null texts are empty, null sources the empty part. A null doc_id counts as larger than
any other, and rows of equal text and equal or null ids don't stop each other. A document's label is
the largest of its non-null ones; null ids have none. Repeated rows count each. An empty table gives
no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, materialise, spread, table

FILTERS = "ABCDE"
SETS = 1 << len(FILTERS)
#: Rows that one index packs; a task indexes its rows in as many turns as it needs.
INDEXED = 1 << 16
_UPPER, _MARKS = bytes(range(65, 91)), b"#$%&*|"
_INNER = bytes(range(128, 192))  # bytes that continue a code point
READ = "id bigint, part string, stopped int, digest binary"
COUNTS = "part string, `set` int, kept bigint, good bigint, toxic bigint"
AUDIT = (
    "part string, filter_order string, step int, kept bigint, removed bigint, redundant bigint, unique_fails bigint, "
    "good_lost bigint, toxic_lost bigint, shapley bigint"
)


def stops(text: bytes) -> int:
    """The filters A to D that a text fails, as bits."""
    words = text.split()  # bytes split at runs of ASCII white space
    n = len(text)
    failed = len(words) < 50
    failed |= (100 * len(set(words)) < 65 * len(words)) << 1
    failed |= (100 * (n - len(text.translate(None, _UPPER))) > 5 * len(text.translate(None, _INNER))) << 2
    return failed | (len(text.translate(None, _MARKS)) < n) << 3


def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, part, text as bytes) to READ."""
    for batch in batches:
        texts = batch.column(2).to_pylist()
        columns = [pa.array([stops(t) for t in texts], pa.int32()), pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary())]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=["id", "part", "stopped", "digest"])


def counted(parts: np.ndarray, stopped: np.ndarray, good: np.ndarray, toxic: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct parts, and of each the counts [kept, good, toxic] for all sets of filters."""
    order = np.argsort(parts, kind="stable")
    names, sizes = np.unique(parts, return_counts=True)
    whole = -(-sizes // 8) * 8  # a part's rows fill whole bytes
    starts = np.cumsum(whole) - whole
    place = np.arange(len(parts)) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)

    def bitset(flags: np.ndarray) -> np.ndarray:
        bits = np.zeros(int(whole.sum()), np.uint8)
        bits[place] = flags[order]
        return np.packbits(bits)

    filters = [bitset((stopped >> i & 1).astype(np.uint8)) for i in range(len(FILTERS))]
    asked = [bitset(np.ones(len(parts), np.uint8)), bitset(good), bitset(toxic)]
    out = np.empty((len(names), SETS, len(asked)), np.int64)
    left = {0: asked}
    for s in range(SETS):
        if s:
            top = s.bit_length() - 1
            left[s] = [rows & ~filters[top] for rows in left[s & ~(1 << top)]]
        for i, rows in enumerate(left[s]):
            out[:, s, i] = np.add.reduceat(np.bitwise_count(rows).astype(np.int64), starts // 8)
    return names, out


def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(part, stopped, good, toxic) to COUNTS of each index."""

    def turn(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held).combine_chunks()
        part = rows.column(0).combine_chunks().dictionary_encode()
        flags = [rows.column(c).to_numpy() for c in (1, 2, 3)]
        codes, counts = counted(part.indices.to_numpy(zero_copy_only=False), flags[0], *[f.astype(np.uint8) for f in flags[1:]])
        names = part.dictionary.take(pa.array(np.repeat(codes, SETS)))
        columns = [names, pa.array(np.tile(np.arange(SETS, dtype=np.int32), len(codes))), *[pa.array(counts[:, :, i].ravel()) for i in range(3)]]
        return pa.RecordBatch.from_arrays(columns, names=["part", "set", "kept", "good", "toxic"])

    held, size = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.num_rows
        if size >= INDEXED:
            yield turn(held)
            held, size = [], 0
    if held:
        yield turn(held)


def orders() -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Of each step of all orders: the order, its filter, the set before it and the set after it."""
    names = sorted("".join(p) for p in permutations(FILTERS))
    which = np.array([[FILTERS.index(c) for c in n] for n in names])
    after = np.cumsum(1 << which, axis=1)
    return names, which, after - (1 << which), after


def audits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(part, counts of all sets in order) to the steps of all orders."""
    names, which, before, after = orders()
    n, full = len(FILTERS), SETS - 1
    one = 1 << np.arange(n)
    # in so many orders the filters of a set come first, then the filter, then the others
    times = np.array([math.factorial(int(s).bit_count()) * math.factorial(max(n - 1 - int(s).bit_count(), 0)) for s in range(SETS)])
    for batch in batches:
        for part, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            kept, good, toxic = (np.array([c[k] for c in counts]) for k in ("kept", "good", "toxic"))
            fails = kept[0] - kept[one]
            unique = kept[full - one] - kept[full]
            outside = [np.flatnonzero(~np.arange(SETS) & o) for o in one]
            shapley = np.array([(times[s] * (kept[s] - kept[s | o])).sum() for s, o in zip(outside, one, strict=True)])
            removed = kept[before] - kept[after]
            values = [kept[after], removed, fails[which] - removed, unique[which], good[before] - good[after], toxic[before] - toxic[after], shapley[which]]
            columns = [pa.array([part] * which.size), pa.array(np.repeat(names, n)), pa.array(np.tile(np.arange(1, n + 1, dtype=np.int32), len(names)))]
            yield pa.RecordBatch.from_arrays([*columns, *[pa.array(v.ravel()) for v in values]], names=[c.split()[0] for c in AUDIT.split(", ")])


def looked_up(rows: DataFrame, key: str, known: DataFrame, total: int) -> DataFrame:
    """``rows`` with the other columns of ``known`` (key, _n and more) joined by ``key``, nulls where it has none.

    ``_n`` is the number of rows of the key. Keys of over a thousandth of all rows are broadcast, a
    thousand at most; their rows, and those without a key, are dealt to all tasks of the other join.
    """
    values = [c for c in known.columns if c not in (key, "_n")]
    often = known.where(F.col("_n") * 1000 > total).select(F.col(key).alias("_often"), *[F.col(c).alias(f"_of_{c}") for c in values])
    # a number modulo 1 is 0, which the optimiser doesn't know; a literal would leave the join by a condition of one side
    rest = known.where(F.col("_n") * 1000 <= total).select(F.col(key).alias("_key"), (F.col("_n") % 1).alias("_deal"), *[F.col(c).alias(f"_{c}") for c in values])
    marked = rows.join(F.broadcast(often), F.col(key) == F.col("_often"), "left")
    alone = F.col("_often").isNotNull() | F.col(key).isNull()
    marked = marked.withColumn("_own", F.when(alone, 1 + F.monotonically_increasing_id()).otherwise(F.lit(0)))
    found = marked.join(rest, (F.col(key) == F.col("_key")) & (F.col("_own") == F.col("_deal")), "left")
    return found.select(*rows.columns, *[F.when(F.col("_often").isNotNull(), F.col(f"_of_{c}")).otherwise(F.col(f"_{c}")).alias(c) for c in values])


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """AUDIT: every step of all orders of the filters for each part."""
    plain = docs.select(F.col("doc_id").cast("bigint").alias("id"), F.coalesce("source", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    rows = materialise(map_arrow(plain, read, READ), "audit-rows")
    total = rows.count()
    texts = rows.groupBy("digest").agg(F.count(F.lit(1)).alias("_n"), F.min("id").alias("first")).where(F.col("_n") > 1)
    later = F.col("first").isNotNull() & (F.col("id").isNull() | (F.col("id") > F.col("first")))
    flagged = looked_up(rows, "digest", texts, total).withColumn("stopped", F.col("stopped") + F.when(later, 1 << 4).otherwise(0))
    label = labels.select(F.col("doc_id").cast("bigint").alias("id"), "quality", "toxic").groupBy("id")
    label = label.agg((F.max("quality") == 1).cast("int").alias("good"), (F.max("toxic") == 1).cast("int").alias("toxic"))
    label = label.join(rows.groupBy("id").agg(F.count(F.lit(1)).alias("_n")), "id")
    known = looked_up(flagged.select("id", "part", "stopped"), "id", label, total)
    indexed = map_arrow(known.select("part", "stopped", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("good", "toxic")]), index, COUNTS)
    sums = indexed.groupBy("part", "set").agg(*[F.sum(c).alias(c) for c in ("kept", "good", "toxic")])
    # as many rows a part as there are sets of filters
    whole = sums.groupBy("part").agg(F.sort_array(F.collect_list(F.struct("set", "kept", "good", "toxic"))).alias("counts"))
    return map_arrow(whole, audits, AUDIT)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(spread(table(spark, sf_dir, "documents")), table(spark, sf_dir, "labels"))


ORACLE_SQL = r"""
WITH label AS (
    SELECT doc_id, (max(quality) = 1)::INT AS good, (max(toxic) = 1)::INT AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
), d AS (
    SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), flags AS (
    SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
        (len(words) < 50)::INT + 2 * (100 * len(list_distinct(words)) < 65 * len(words))::INT
        + 4 * (100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 5 * length(t))::INT
        + 8 * regexp_matches(t, '[#$%&*|]')::INT
        + 16 * coalesce(coalesce(d.doc_id, 9223372036854775807) > min(d.doc_id) OVER (PARTITION BY t), false)::INT AS bits
    FROM d LEFT JOIN label ON d.doc_id = label.doc_id
), counts AS (
    SELECT part, bits, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM flags GROUP BY part, bits
), f(l, m) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
orders AS (
    SELECT a.l || b.l || c.l || d.l || e.l AS filter_order, [a.m, b.m, c.m, d.m, e.m] AS masks
    FROM f a, f b, f c, f d, f e WHERE a.m + b.m + c.m + d.m + e.m = 31 AND len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5
), steps AS (
    SELECT filter_order, step, masks[step] AS own, coalesce(list_sum(masks[1:step - 1]), 0)::INT AS ahead
    FROM orders, (SELECT unnest(range(1, 6))::INT AS step)
), found AS (
    SELECT part, filter_order, step, any_value(own) AS own,
        sum(CASE WHEN bits & (ahead | own) = 0 THEN n ELSE 0 END) AS kept,
        sum(CASE WHEN bits & ahead = 0 AND bits & own > 0 THEN n ELSE 0 END) AS removed,
        sum(CASE WHEN bits & ahead > 0 AND bits & own > 0 THEN n ELSE 0 END) AS redundant,
        sum(CASE WHEN bits = own THEN n ELSE 0 END) AS unique_fails,
        sum(CASE WHEN bits & ahead = 0 AND bits & own > 0 THEN good ELSE 0 END) AS good_lost,
        sum(CASE WHEN bits & ahead = 0 AND bits & own > 0 THEN toxic ELSE 0 END) AS toxic_lost
    FROM counts, steps GROUP BY part, filter_order, step
)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
    unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
    (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley
FROM found
"""
