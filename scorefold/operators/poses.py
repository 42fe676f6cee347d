"""Ranking and selection of poses: clusters of near poses, their quality and representatives, tiers and quotas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .ranking import place


def cluster_qualities(clustered: DataFrame, group: list[str], family: str, score: str, key: str) -> DataFrame:
    """Per cluster: first key, size, families and six qualities; poses without a score count 0."""
    best = F.coalesce(F.max(score), F.lit(0.0))
    sums = clustered.groupBy(*group, "cluster").agg(
        F.min(key).alias("first"), F.count(F.lit(1)).alias("size"), F.count_distinct(family).alias("families"), best.alias("best"), F.coalesce(F.sum(score), F.lit(0.0)).alias("total")
    )
    return sums.withColumns(
        {
            "by_families": F.round(F.col("best") * F.log(1.0 + F.col("families")), 6),
            "by_size_log": F.round(F.col("best") * F.log(1.0 + F.col("size")), 6),
            "by_size": F.round(F.col("size") * F.col("best"), 6),
            "total": F.round("total", 6),
        }
    )


def representative(group: list[str], deviation: str, score: str, key: str) -> Column:
    """The place of a pose in its group: least deviation (equal ones by best score), else best score, else first."""
    return place(group, F.asc_nulls_last(deviation), F.desc_nulls_last(score), F.asc(key))


def top_clusters(clustered: DataFrame, group: list[str], family: str, score: str, deviation: str, key: str, k: int) -> DataFrame:
    """The representatives of the ``k`` best clusters of each group; equal qualities keep the order of their first poses."""
    ranked = cluster_qualities(clustered, group, family, score, key).withColumn("rank", place(group, F.desc("by_families"), F.asc("first"))).where(F.col("rank") <= k)
    reps = clustered.withColumn("_at", representative([*group, "cluster"], deviation, score, key)).where("_at = 1")
    return ranked.select(*group, "cluster", "rank", "by_families").join(reps.select(*group, "cluster", key), [*group, "cluster"])


def final_scores(df: DataFrame, rrf: str, support: str, score: str, aligned: Column) -> DataFrame:
    """Adds final: the fused rank, raised by consensus support, and a bonus for aligned poses."""
    bonus = F.when(aligned, 0.2 * F.coalesce(F.col(score), F.lit(0.0))).otherwise(0.0)
    return df.withColumn("final", F.round(F.col(rrf) * (1 + 0.1 * F.log(1.0 + F.col(support))) + bonus, 9))


def strategies(df: DataFrame, group: str, choices: dict[str, list[Column]], truth: str, key: list[str], native: float) -> DataFrame:
    """Per strategy, an order of rows: groups, first picks that are native and the mean truth of the picks."""
    out = None
    ids = list(map(F.asc, key))
    for name, order in choices.items():
        first = df.withColumn("_at", place([group], *order, *ids)).where("_at = 1")
        row = first.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(truth) < native).alias("hits"), F.round(F.avg(truth), 6).alias("mean_truth")).select(F.lit(name).alias("strategy"), "*")
        out = row if out is None else out.unionByName(row)
    return out


def per_ligand(df: DataFrame, target: str, ligand: str, primary: Column, order: list[Column], k: int) -> DataFrame:
    """The ``k`` first rows of each (target, ligand); rows without a ligand belong to the primary one."""
    own = df.withColumn(ligand, F.coalesce(F.col(ligand), primary))
    return own.withColumn("rank", place([target, ligand], *order)).where(F.col("rank") <= k)


def sites_by_share(sites: DataFrame, group: str, evidence: str, entries: str, key: str, k: int = 2) -> DataFrame:
    """Sites with a share of at least 0.2 and two entries, the first ``k`` by evidence; else the top one with 0.3 and three entries."""
    order = Window.partitionBy(group).orderBy(F.desc(evidence), key)
    shared = sites.withColumns({"share": F.col(evidence) / F.sum(evidence).over(Window.partitionBy(group)), "_at": F.row_number().over(order)})
    good = F.coalesce((F.col("share") >= 0.2) & (F.col(entries) >= 2), F.lit(False))
    lone = (F.col("_at") == 1) & (F.col("share") >= 0.3) & (F.col(entries) >= 3)
    marked = shared.withColumns({"_good": good, "_any": F.max(good).over(Window.partitionBy(group))}).where(F.col("_good") | (~F.col("_any") & lone))
    ranked = marked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.withColumn("weight", F.round(1 + F.col("share"), 3)).drop("_at", "_good", "_any", "share")


def surfaced(df: DataFrame, source: str, order: list[Column], distance: Column, key: str, n: int) -> DataFrame:
    """The ``n`` first rows of each source and the one nearest to an anchor, each once."""
    ranked = df.withColumns({"_at": place([source], *order, F.asc(key)), "_near": place([source], F.asc_nulls_last(distance), F.asc(key))})
    return ranked.where((F.col("_at") <= n) | (F.col("_near") == 1)).withColumn("nearest", F.col("_near") == 1).drop("_near").withColumnRenamed("_at", "rank")


def moved_to_front(df: DataFrame, group: str, rank: str, wanted: Column, score: str) -> DataFrame:
    """Ranks after the wanted row with the best score comes first; the others keep their order."""
    best = F.row_number().over(Window.partitionBy(group).orderBy(F.desc(wanted.cast("int")), F.desc_nulls_last(score), F.asc(rank)))
    front = df.withColumn("_front", (best == 1) & wanted)
    return front.withColumn("new_rank", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("_front"), F.asc(rank)))).drop("_front")


def by_priority(df: DataFrame, group: str, kind: str, priority: list[str], order: list[Column]) -> DataFrame:
    """One row per group: of the first kind of ``priority`` that it has, the first in order; unlisted kinds don't count."""
    at = F.array_position(F.array(*map(F.lit, priority)), F.col(kind))
    return df.where(F.col(kind).isin(*priority)).withColumn("_at", place([group], at.asc(), *order)).where("_at = 1").drop("_at")


def boxes(points: DataFrame, group: list[str], scale: float, padding: float = 8.0, least: float = 22.5, most: float = 40.0) -> DataFrame:
    """Per group the centre of its bounding box and a box side: largest extent and padding, kept within bounds."""
    axes = ("x", "y", "z")
    found = points.groupBy(*group).agg(*[F.min(a).alias(f"low_{a}") for a in axes], *[F.max(a).alias(f"high_{a}") for a in axes])
    extent = F.greatest(*[(F.col(f"high_{a}") - F.col(f"low_{a}")) * scale for a in axes])
    side = F.round(F.greatest(F.lit(least), F.least(F.lit(most), extent + padding)), 6)
    return found.select(*group, *[F.round((F.col(f"low_{a}") + F.col(f"high_{a}")) / 2, 6).alias(f"centre_{a}") for a in axes], side.alias("side"))


def extents(points: DataFrame, group: list[str], margin: float) -> DataFrame:
    """Per group the mean point, the largest distance to it and how many lie ``margin`` times the mean distance away or more."""
    axes = ("x", "y", "z")
    centre = points.groupBy(*group).agg(*[F.avg(a).alias(f"c{a}") for a in axes])
    far = F.sqrt(sum((F.pow(F.col(a) - F.col(f"c{a}"), F.lit(2)) for a in axes[1:]), F.pow(F.col("x") - F.col("cx"), F.lit(2))))
    away = points.join(centre, group).withColumn("_far", F.round(far, 9))
    mean = away.groupBy(*group).agg(F.avg("_far").alias("_mean"))
    found = away.join(mean, group).groupBy(*group)
    return found.agg(F.count(F.lit(1)).alias("n"), F.round(F.max("_far"), 6).alias("radius"), F.count_if(F.col("_far") >= margin * F.col("_mean")).alias("outliers"))


def template_anchors(points: DataFrame, group: list[str], entry: str, weight: str) -> DataFrame:
    """Per group the entry with the largest weight (then the smallest name), with the mean of its points."""
    means = points.groupBy(*group, entry).agg(F.max(weight).alias("weight"), F.count(F.lit(1)).alias("n"), *[F.round(F.avg(a), 6).alias(a) for a in ("x", "y", "z")])
    return means.withColumn("_at", place(group, F.desc_nulls_last("weight"), F.asc(entry))).where("_at = 1").drop("_at")


def anchors(templates: DataFrame, research: DataFrame, modes: DataFrame, group: list[str]) -> DataFrame:
    """kind, group, x, y, z: the mean template and research points of each group; where it has neither, its density mode."""
    axes = ("x", "y", "z")
    mean = lambda points, kind: points.groupBy(*group).agg(*[F.round(F.avg(a), 6).alias(a) for a in axes]).select(F.lit(kind).alias("kind"), *group, *axes)
    placed = mean(templates, "template").unionByName(mean(research, "research"))
    rest = modes.select(F.lit("density").alias("kind"), *group, *[F.col(f"mean_{a}").alias(a) for a in axes])
    return placed.unionByName(rest.join(placed.select(*group).distinct(), group, "left_anti"))
