"""Success rates of ranked pools, at the level of targets and of clusters of targets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .pools import upper_medians
from .ranking import place


def outcomes(df: DataFrame, group: list[str], score: str, truth: str, key: list[str], native: float, ascending: bool = False) -> DataFrame:
    """Per group: n_rows, truth of the best, least truth of the best five and of all, and whether each is below ``native``."""
    rows = df.where(F.col(score).isNotNull() & F.col(truth).isNotNull())
    order = F.asc(score) if ascending else F.desc(score)
    ranked = rows.withColumn("_place", place(group, order, *map(F.asc, key)))
    found = ranked.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.min(F.when(F.col("_place") == 1, F.col(truth))).alias("top1"),
        F.min(F.when(F.col("_place") <= 5, F.col(truth))).alias("top5"),
        F.min(truth).alias("oracle"),
    )
    return found.withColumns({f"{m}_native": F.col(m) < native for m in ("top1", "top5", "oracle")})


METRICS = ("top1_native", "top5_native", "oracle_native")


def rate(flag: Column) -> Column:
    return F.round(F.avg(flag.cast("double")), 6)


def rates(metrics: DataFrame, policy: str, zone: str = "zone") -> DataFrame:
    """policy, zone, n and the mean of each metric, per zone and over ALL, in one pass."""
    cube = metrics.groupingSets([[F.col(zone)], []], F.col(zone)).agg(
        F.grouping(zone).alias("_all"), F.count(F.lit(1)).alias("n"), *[rate(F.col(m)).alias(m) for m in METRICS]
    )
    return cube.select(F.lit(policy).alias("policy"), F.when(F.col("_all") == 1, "ALL").otherwise(F.col(zone)).alias("zone"), "n", *METRICS)


def cluster_policies(metrics: DataFrame, target: str, cluster: str) -> DataFrame:
    """Rates by target, by representatives only, by any member and by the mean of members."""
    rep = F.min(target).over(Window.partitionBy(cluster))
    by_rep = metrics.withColumn("_rep", rep)
    grouped = by_rep.groupBy(cluster)
    zone = F.min_by("zone", target).alias("zone")
    any_member = grouped.agg(zone, *[F.max(F.col(m)).alias(m) for m in METRICS])
    mean = grouped.agg(zone, *[F.avg(F.col(m).cast("double")).alias(m) for m in METRICS])
    parts = [
        rates(metrics, "per_target"),
        rates(by_rep.where(F.col(target) == F.col("_rep")), "cluster_rep_only"),
        rates(any_member, "cluster_any"),
        rates(mean, "cluster_mean"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def topk_curve(df: DataFrame, group: list[str], score: str, truth: str, key: list[str], native: float, ks: list[int]) -> DataFrame:
    """Share of groups with a native row among their K best, for every K."""
    ranked = df.withColumn("_place", place(group, F.desc(score), *map(F.asc, key)))
    first = ranked.groupBy(*group).agg(F.min(F.when(F.col(truth) < native, F.col("_place"))).alias("first"))
    spread = first.select(F.explode(F.array(*map(F.lit, ks))).alias("k"), F.coalesce(F.col("first") <= F.col("k"), F.lit(False)).alias("hit"))
    return spread.groupBy("k").agg(F.count(F.lit(1)).alias("n_groups"), rate(F.col("hit")).alias("success"))


def scorer_table(df: DataFrame, group: list[str], scorers: dict[str, bool], truth: str, key: list[str], native: float) -> DataFrame:
    """Per scorer (True: lower is better): groups, top-1 and best-5 successes and upper medians."""
    entries = [F.struct(F.lit(n).alias("scorer"), (-F.col(n) if low else F.col(n)).cast("double").alias("_score")) for n, low in scorers.items()]
    long = df.select(*group, truth, *key, F.explode(F.array(*entries)).alias("_e")).select("*", "_e.*")
    found = outcomes(long, ["scorer", *group], "_score", truth, key, native)
    counts = found.groupBy("scorer").agg(F.count(F.lit(1)).alias("n"), F.count_if("top1_native").alias("top1_hits"), F.count_if("top5_native").alias("best5_hits"))
    middle = upper_medians(found, ["scorer"], ["top1", "top5"]).withColumnsRenamed({"top1": "median_top1", "top5": "median_best5"})
    return counts.join(middle, "scorer")
