"""Rank fusion and selection within groups; every order ends in a unique key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .lineage import dealt, settled


def place(group: list[str], *order: Column) -> Column:
    return F.row_number().over(Window.partitionBy(*group).orderBy(*order))


def reciprocal_ranks(df: DataFrame, group: list[str], scores: list[str], key: list[str], k: int = 60) -> DataFrame:
    """Adds rrf: the sum of 1 / (k + place) over the score lists; a NULL isn't in its list."""
    total = F.lit(0.0)
    for s in scores:
        at = place([*group, F.col(s).isNull()], F.desc(s), *map(F.asc, key))
        total = total + F.when(F.col(s).isNotNull(), 1 / (k + at)).otherwise(0.0)
    return df.withColumn("rrf", total)


def tiered_best(df: DataFrame, group: list[str], tiers: list[str], key: list[str]) -> DataFrame:
    """One row per group: the largest of the first tier that any row has, else of the next; else the first row."""
    order = [F.desc_nulls_last(t) for t in tiers]
    return df.withColumn("_place", place(group, *order, *map(F.asc, key))).where("_place = 1").drop("_place")


def cascade(df: DataFrame, group: list[str], score: str, tie: str, favoured: Column, key: list[str], pool: int = 50, margin: float = 0.1) -> DataFrame:
    """One row per group among its ``pool`` best: the best favoured row if it's within ``margin`` of the best, else the best."""
    ids = list(map(F.asc, key))
    top = df.withColumn("_place", place(group, F.desc_nulls_last(score), *ids)).where(F.col("_place") <= pool)
    best = F.max(score).over(Window.partitionBy(*group))
    close = favoured & F.coalesce(best - F.col(score) < margin, F.lit(False))
    return top.withColumn("_pick", place(group, F.desc(close), F.desc_nulls_last(score), F.desc_nulls_last(tie), *ids)).where("_pick = 1").drop("_place", "_pick")


def average_ranks(df: DataFrame, group: list[str], score: str, out: str) -> DataFrame:
    """Descending ranks within groups, ties averaged."""
    ties = F.count(F.lit(1)).over(Window.partitionBy(*group, score))
    return df.withColumn(out, F.rank().over(Window.partitionBy(*group).orderBy(F.desc(score))) + (ties - 1) / 2)


def diverse_top_k(df: DataFrame, group: list[str], score: str, vector: str, key: str, k: int = 5, distance: float = 2.0, copies_apart: bool = False) -> DataFrame:
    """Greedy selection per group: best first, each at least ``distance`` from all chosen before (or at 0, where copies count as apart).

    A round chooses the best row left in each group and drops the rows too close to it, so no group
    is walked in one task. The first of a group is chosen with any vector; later ones need a whole one.
    """
    order = F.struct(~F.isnan(F.col(score).cast("double")), -F.col(score), F.col(key))
    left = df.where(F.col(score).isNotNull()).select(*group, key, score, vector).transform(settled)
    squares = F.zip_with(F.col(vector), F.col("_best")[vector], lambda a, b: (a.cast("double") - b) * (a.cast("double") - b))
    apart = F.sqrt(F.aggregate(squares, F.lit(0.0), lambda total, x: total + x))
    whole = lambda v: F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double"))), F.lit(False))
    far = ~whole(F.col("_best")[vector]) | ((apart >= distance) & ~F.isnan(apart)) | (F.lit(copies_apart) & (apart == 0))
    same = F.lit(True)
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"_{g}"))
    chosen = []
    for rank in range(1, max(k, 1) + 1):
        best = left.groupBy(*group).agg(F.min_by(F.struct(key, score, vector), order).alias("_best")).transform(settled)
        chosen.append(best.select(*group, F.col("_best")[key].alias(key), F.col("_best")[score].alias(score), F.lit(rank).alias("rank")))
        if rank >= k or not best.take(1):
            break
        # one row per group; the chosen row itself goes, even where the distance is zero
        near = best.withColumnsRenamed({g: f"_{g}" for g in group})
        itself = F.col(key).eqNullSafe(F.col("_best")[key])
        left = left.join(near, same).where(whole(F.col(vector)) & far & ~itself).select(left.columns).transform(settled)
    found = chosen[0]
    for more in chosen[1:]:
        found = found.unionByName(more)
    return found.where(F.col("rank") <= k)


def rank_sum_best(df: DataFrame, group: list[str], scores: list[str], key: list[str]) -> DataFrame:
    """One row per group: the smallest sum of tie-averaged descending ranks over the scores.

    A task sorts its rows anew for each score and each of its ties, so groups are dealt by the number of rows.
    """
    df = dealt(df, group)
    for i, s in enumerate(scores):
        df = average_ranks(df, group, s, f"_r{i}")
    total = sum((F.col(f"_r{i}") for i in range(1, len(scores))), F.col("_r0"))
    summed = df.withColumn("rank_sum", total)
    best = summed.withColumn("_place", place(group, F.asc("rank_sum"), *map(F.asc, key))).where("_place = 1")
    return best.drop("_place", *[f"_r{i}" for i in range(len(scores))])
