"""Temperature mixing of sources and its realisation as budgeted block permutations.

A source's weight is its share of the tokens to the power of an exponent, normalised. The exponent is
bisected: the largest one (1 keeps the shares, 0 makes all sources equal) whose weights reach a
target entropy, raised as far as needed so that no source is repeated more often than a limit.
Tokens are counted as white-space separated words.

The weights are realised exactly up to one document per source: each source runs through whole
epochs, each a permutation of its blocks and of the documents in each block, until its budget is
spent. Sources are cut into blocks by a hash of the document, one for each BLOCK tokens but at most
BLOCKS of them, so that a source of any size is many groups and its blocks are few enough to be added
up in one; positions follow from sums over blocks. The stream is then cut into mixed blocks, each of
which holds all sources in proportion to their weights, in permuted order.

Defined cases: a null source is a source of its own; null and empty texts have no tokens and stay with
the first epoch of their source; repeated rows count each; sources without tokens get weight 0 and
one epoch; an empty table gives an empty result; further columns of the input may have any names. Weights are
found on the driver from the distinct sizes of sources, which are few however many sources there are.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialise, numbered, table

#: Share of the largest possible entropy that weights are to reach, most epochs of a source, tokens of a block.
ENTROPY, REPETITION, BLOCK = 0.97, 2.0, 50_000
#: Most blocks of a source in an epoch; so many sources are broadcast, more are joined by a shuffle.
BLOCKS, FEW_SOURCES = 1 << 16, 100_000


def tokens(text: Column) -> Column:
    trimmed = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), "\\s+", " "))
    return F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, " "))).cast("bigint")


def tempered(counts: list[int], exponent: float, many: list[int]) -> list[float]:
    total = sum(c * m for c, m in zip(counts, many, strict=True))
    raw = [(c / total) ** exponent if c else 0.0 for c in counts]
    whole = sum(r * m for r, m in zip(raw, many, strict=True))
    return [r / whole for r in raw]


def entropy(weights: list[float], many: list[int] | None = None) -> float:
    return -sum(m * w * math.log(w) for w, m in zip(weights, many or [1] * len(weights), strict=True) if w)


def bisect(holds, steps: int = 60) -> float:
    """The largest exponent in [0, 1] that holds; ``holds`` is true up to some exponent."""
    low, high = 0.0, 1.0
    if holds(high):
        return high
    for _ in range(steps):
        middle = (low + high) / 2
        low, high = (middle, high) if holds(middle) else (low, middle)
    return low


def weights(
    counts: list[int], budget: int | None, target: float = ENTROPY, limit: float = REPETITION, many: list[int] | None = None
) -> tuple[float, list[float], int]:
    """(exponent, weights, budget): the exponent for the entropy, raised until the repetition limit holds.

    With ``many`` each count stands for so many sources, and its weight is that of one of them. Without a budget it is the one that gives every source at least one epoch, so no document is left out.
    """
    many = many or [1] * len(counts)
    full = math.log(max(2, sum(m for c, m in zip(counts, many, strict=True) if c)))
    exponent = bisect(lambda e: entropy(tempered(counts, e, many), many) >= target * full)

    def spent(e: float) -> tuple[list[float], int]:
        w = tempered(counts, e, many)
        return w, budget if budget is not None else math.ceil(max(c / x for c, x in zip(counts, w, strict=True) if c))

    def repeats(e: float) -> float:
        w, tokens = spent(e)
        return max(x * tokens / c for c, x in zip(counts, w, strict=True) if c)

    if repeats(exponent) > limit:
        # repetition falls as the exponent rises towards the shares themselves
        exponent = 1 - bisect(lambda r: repeats(1 - r) <= limit)
    return exponent, *spent(exponent)


def mix(
    docs: DataFrame, keep: list[str], budget: int | None, whole: bool = False, seed: int = 17, by: list[Column] | None = None
) -> DataFrame:
    """Rows of the mixed stream: ``keep`` columns, source, n_tokens, epoch, block, position, weight.

    ``keep`` should be narrow; texts are joined later by id. With ``whole`` a source's first epoch is
    always complete. Documents are permuted by a hash of ``by``, else of ``keep``.
    """
    spark = docs.sparkSession
    names = [F.xxhash64(*by).alias("_name")] if by else []
    rows = materialise(docs.select(*keep, *names, F.col("source").alias("source"), tokens(F.col("text")).alias("n_tokens")), "mix-rows")
    sources = materialise(rows.groupBy("source").agg(F.sum("n_tokens").alias("t")), "mix-sources")
    number = sources.count()
    if not number:
        return rows.select("*", *[F.lit(0).cast("bigint").alias(c) for c in ("epoch", "block", "position")], F.lit(0.0).alias("weight"))
    # sources of one size have one weight; n sizes take n^2 / 2 tokens at least, so sizes are few whatever the sources
    found = sources.groupBy("t").count().orderBy("t").collect()
    counts, many = [r["t"] for r in found], [r["count"] for r in found]
    exponent, shares, budget = weights(counts, budget, many=many) if sum(counts) else (1.0, [1 / number], 0)
    spend = [(t, w, float(w * budget), min(BLOCKS, max(1, -(-t // BLOCK)))) for t, w in zip(counts, shares, strict=True)]
    sizes = spark.createDataFrame(spend, "t bigint, weight double, spend double, blocks bigint")
    plan = sources.join(F.broadcast(sizes), "t").withColumnRenamed("source", "s")
    plan = F.broadcast(plan) if number <= FEW_SOURCES else plan
    epochs = F.greatest(F.lit(1), F.ceil(F.col("spend") / F.greatest(F.col("t"), F.lit(1)) - 1e-9)).cast("int")
    dealt = rows.join(plan, F.col("source").eqNullSafe(F.col("s"))).withColumn("epoch", F.explode(F.sequence(F.lit(0), epochs - 1)))
    dealt = dealt.withColumn("order", F.xxhash64(*(["_name"] if by else keep), "epoch", F.lit(seed))).withColumn("part", F.pmod(F.xxhash64("order", F.lit(1)), F.col("blocks")))
    dealt = materialise(dealt, "mix-dealt")
    # permuted blocks: sums over one row per block, a source has one for each BLOCK tokens and epoch
    sums = dealt.groupBy("s", "epoch", "part").agg(F.sum("n_tokens").alias("held"))
    before = Window.partitionBy("s").orderBy("epoch", F.xxhash64("part", "epoch", F.lit(seed)), "part").rowsBetween(Window.unboundedPreceding, -1)
    starts = materialise(sums.withColumn("base", F.coalesce(F.sum("held").over(before), F.lit(0))), "mix-blocks")
    starts = starts.select(F.col("s").alias("s2"), F.col("epoch").alias("e2"), F.col("part").alias("p2"), "base")
    same = F.col("s").eqNullSafe(F.col("s2")) & (F.col("epoch") == F.col("e2")) & (F.col("part") == F.col("p2"))
    inside = Window.partitionBy("s", "epoch", "part").orderBy("order", *keep).rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.join(starts, same).withColumn("at", F.col("base") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    fits = F.col("at") < F.col("spend")
    placed = placed.where(fits | (F.col("epoch") == 0) if whole else fits | ((F.col("epoch") == 0) & (F.col("n_tokens") == 0)))
    mixed = max(1, -(-budget // BLOCK))
    share = F.col("at") / F.greatest(F.col("spend"), F.lit(1.0))
    placed = placed.withColumn("block", F.least(F.floor(share * mixed), F.lit(mixed - 1)).cast("bigint"))
    order = Window.partitionBy("block").orderBy(F.xxhash64("order", "s", F.lit(seed)), "s", "epoch", *keep)
    return placed.withColumn("position", (F.row_number().over(order) - 1).cast("bigint")).select(
        *keep, "source", "n_tokens", F.col("epoch").cast("bigint").alias("epoch"), "block", "position", "weight"
    )


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every document at least once, those of small sources again as the weights ask.

    The rows come in the order of the stream: each block of it lies in one partition, by position.
    Rows are told apart by their place in the files, as doc_ids may be null or repeat. Which
    documents come again depends on doc_id and text, not on the places.
    """
    rows, row = numbered(docs, "mix-input")
    mixed = mix(rows, [row], None, whole=True, by=[F.col("doc_id"), F.col("text")])
    block, position = f"{row}_block", f"{row}_position"
    stream = mixed.select(row, F.col("block").alias(block), F.col("position").alias(position)).join(rows, row)
    return stream.repartition(block).sortWithinPartitions(block, position).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stream for a budget of all tokens of the corpus."""
    docs = table(spark, sf_dir, "documents")
    budget = docs.agg(F.sum(tokens(F.col("text"))).alias("t")).first().t or 0
    return mix(docs, ["doc_id"], int(budget))
