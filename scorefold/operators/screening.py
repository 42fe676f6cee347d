"""Screening metrics over one ranked list of any length.

Ranks are global, yet no window is: rows are dealt to ranges of (score, key), written, and the sums of
the ranges above are added to the running sums within a range. Equal scores may lie in several ranges.
Totals are found, and ranges written, when a query is built.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .lineage import settled


def running(df: DataFrame, score: str, sums: list[str], key: list[str]) -> DataFrame:
    """Adds ``<s>_before``, the sum over all rows that come earlier by (score descending, key)."""
    order = [F.desc(score), *map(F.asc, key)]
    parted = df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()).transform(settled)
    totals = parted.groupBy("_part").agg(*[F.sum(s).alias(f"_{s}") for s in sums])  # a row for each shuffle partition
    above = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("_part", *[F.coalesce(F.sum(f"_{s}").over(above), F.lit(0)).alias(f"_{s}") for s in sums])
    before = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    joined = parted.join(F.broadcast(totals), "_part")
    within = {f"{s}_before": F.col(f"_{s}") + F.coalesce(F.sum(s).over(before), F.lit(0)) for s in sums}
    return joined.withColumns(within).drop("_part", *[f"_{s}" for s in sums])


def by_score(df: DataFrame, score: str, label: str) -> DataFrame:
    """One row per distinct score: rows n, hits, and both sums before it."""
    rows = df.where(F.col(score).isNotNull() & F.col(label).isNotNull())
    found = rows.groupBy(score).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("long")).alias("hits"))
    return running(found, score, ["n", "hits"], [])


def metrics(df: DataFrame, score: str, label: str, key: list[str], alpha: float = 20.0, shares: tuple[float, ...] = (0.01, 0.05, 0.1)) -> DataFrame:
    """n_rows, n_hits, auc, bedroc on tie-averaged ranks, and enrichment factors on the stable order."""
    rows = df.where(F.col(score).isNotNull() & F.col(label).isNotNull()).withColumn("_one", F.lit(1).cast("long"))
    total = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("long")).alias("p")).first()
    n, p = total.n, total.p or 0
    both = bool(p) and p < n
    rank = F.col("n_before") + (F.col("n") + 1) / 2
    ranked = by_score(df, score, label).agg(F.sum(F.col("hits") * rank).alias("r"), F.sum(F.col("hits") * F.exp(-alpha * rank / max(n, 1))).alias("e"))
    placed = running(rows, score, ["_one"], key)
    tops = {f"ef{round(100 * f)}": max(1, round(n * f)) for f in shares}
    hits = placed.agg(*[F.sum(F.when(F.col("_one_before") < k, F.col(label).cast("long"))).alias(c) for c, k in tops.items()])
    null = F.lit(None).cast("double")
    if both:
        ra = p / n
        rie = F.col("e") / p / ((1 - math.exp(-alpha)) / n / (math.exp(alpha / n) - 1))
        scale = ra * math.sinh(alpha / 2) / (math.cosh(alpha / 2) - math.cosh(alpha / 2 - alpha * ra))
        bedroc = rie * scale + 1 / (1 - math.exp(alpha * (1 - ra)))
        auc = 1 - (F.col("r") - p * (p + 1) / 2) / (p * (n - p))
    else:
        auc = bedroc = null
    enriched = [F.round((F.col(c) / k) / (p / n), 6).alias(c) if p else null.alias(c) for c, k in tops.items()]
    scores = ranked.select(F.lit(n).cast("long").alias("n_rows"), F.lit(p).cast("long").alias("n_hits"), F.round(auc, 6).alias("auc"), F.round(bedroc, 6).alias("bedroc"))
    return scores.join(hits.select(*enriched), F.lit(True))  # one row each


def roc_points(df: DataFrame, score: str, label: str) -> DataFrame:
    """One point per distinct score, and (0, 0)."""
    found = by_score(df, score, label)
    total = found.agg(F.sum("n").alias("n"), F.sum("hits").alias("p")).first()
    p, q = total.p or 0, (total.n or 0) - (total.p or 0)
    tp, seen = F.col("hits_before") + F.col("hits"), F.col("n_before") + F.col("n")
    points = found.select(F.round((seen - tp) / F.nullif(F.lit(q), F.lit(0)), 6).alias("fpr"), F.round(tp / F.nullif(F.lit(p), F.lit(0)), 6).alias("tpr"))
    return points.unionByName(df.sparkSession.createDataFrame([(0.0, 0.0)], "fpr double, tpr double"))


def enrichment(df: DataFrame, score: str, label: str, key: list[str]) -> DataFrame:
    """Every row with the share of rows and of hits up to it, best score first, ties by the key."""
    rows = df.where(F.col(score).isNotNull() & F.col(label).isNotNull()).withColumns({"_one": F.lit(1).cast("long"), "_hit": F.col(label).cast("long")})
    total = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("_hit").alias("p")).first()
    placed = running(rows, score, ["_one", "_hit"], key)
    recall = (F.col("_hit_before") + F.col("_hit")) / F.nullif(F.lit(total.p or 0), F.lit(0))
    return placed.select(*key, F.round((F.col("_one_before") + 1) / F.lit(total.n), 6).alias("fraction"), F.round(recall, 6).alias("recall"))


def recall_at(df: DataFrame, score: str, label: str, key: list[str], share: float) -> DataFrame:
    """The recall of the first row at or beyond ``share`` of all rows."""
    return enrichment(df, score, label, key).where(F.col("fraction") >= share).agg(F.min("recall").alias("recall"))


def grouped_auc(df: DataFrame, group: list[str], score: str, label: str) -> DataFrame:
    """n, hits and ROC-AUC per group; NULL where a group has one class only. Equal scores are counted first."""
    rows = df.where(F.col(score).isNotNull() & F.col(label).isNotNull())
    counted = rows.groupBy(*group, score).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("long")).alias("h"))
    below = F.coalesce(F.sum(F.col("n") - F.col("h")).over(Window.partitionBy(*group).orderBy(score).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    won = F.col("h") * (below + (F.col("n") - F.col("h")) / 2)
    found = counted.withColumn("_won", won).groupBy(*group).agg(F.sum("n").alias("n"), F.sum("h").alias("hits"), F.sum("_won").alias("_won"))
    pairs = F.col("hits") * (F.col("n") - F.col("hits"))
    return found.select(*group, "n", "hits", F.when(pairs > 0, F.round(F.col("_won") / pairs, 6)).alias("auc"))


#: Ranks that are drawn from at once.
RANKS = 1 << 20


def drawn_sum(n: int, hits: int, alpha: float, rng: np.random.Generator) -> float:
    """Sum of exp(-alpha rank / n) over ``hits`` ranks of 1 .. n drawn without replacement, block by block of ranks."""
    total, left = 0.0, hits
    for first in range(0, n, RANKS):
        size = min(RANKS, n - first)
        here = left if first + size == n else int(rng.hypergeometric(left, n - first - left, size))
        total += float(np.exp(-alpha / n * (first + 1 + rng.choice(size, here, replace=False, shuffle=False))).sum())
        left -= here
    return total


def random_bedroc(sizes: DataFrame, group: str, n: str, hits: str, alpha: float = 20.0, draws: int = 2000, seed: int = 0) -> DataFrame:
    """group, n, hits, mean, p95 of BEDROC over random orders, each draw with its own seed; NULL where all or no rows are hits.

    ``sizes`` has a row per group; a draw holds RANKS ranks at most and below 10^9 rows a group.
    """
    schema = f"{group} {dict(sizes.dtypes)[group]}, n bigint, hits bigint, value double"

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            sums = [drawn_sum(int(a), int(k), alpha, np.random.default_rng([seed, int(t)])) for a, k, t in zip(rows["n"], rows["hits"], rows["draw"], strict=True)]
            a, k = rows["n"].astype(float), rows["hits"].astype(float)
            rie = sums / k / ((1 - np.exp(-alpha)) / a / (np.exp(alpha / a) - 1))
            scale = k / a * np.sinh(alpha / 2) / (np.cosh(alpha / 2) - np.cosh(alpha / 2 - alpha * k / a))
            yield rows.drop(columns="draw").assign(value=rie * scale + 1 / (1 - np.exp(alpha * (1 - k / a))))

    known = sizes.select(group, F.col(n).cast("long").alias("n"), F.col(hits).cast("long").alias("hits"))
    dealt = known.where("hits > 0 AND hits < n").withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))).repartition(group, "draw")
    found = dealt.mapInPandas(draw, schema).groupBy(group).agg(F.round(F.avg("value"), 6).alias("mean"), F.round(F.percentile("value", 0.95), 6).alias("p95"))
    return known.join(found, group, "left")
