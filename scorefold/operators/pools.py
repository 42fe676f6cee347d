"""Statistics of pools of candidates: by scorer, by family and by target."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .ranking import place
from .screening import running


def percent(part: Column, whole: Column) -> Column:
    return F.round(100 * part / whole, 6)


def upper_medians(df: DataFrame, group: list[str], values: list[str]) -> DataFrame:
    """Per group the element at n // 2 of the sorted values of each column, NULLs left out.

    Equal values are counted first and the counts added up, so no group is collected.
    """
    long = df.select(*group, F.explode(F.array(*[F.struct(F.lit(v).alias("name"), F.col(v).cast("double").alias("value")) for v in values])).alias("e"))
    counted = long.where("e.value IS NOT NULL").groupBy(*group, "e.name", "e.value").agg(F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy(*group, "name")
    upto = F.sum("n").over(whole.orderBy("value"))
    at = counted.withColumns({"_upto": upto, "_all": F.sum("n").over(whole)}).where("_upto > floor(_all / 2)")
    return at.groupBy(*group).agg(*[F.min(F.when(F.col("name") == v, F.col("value"))).alias(v) for v in values])


def scorer_pools(df: DataFrame, target: str, scorers: dict[str, tuple[Column, Column]], truth: str, key: list[str], native: float, tight: float) -> DataFrame:
    """Per scorer (its score, which rows are in its pool): targets, mean pool size and top-1, best-5 and tight successes."""
    entries = [F.struct(F.lit(n).alias("scorer"), score.cast("double").alias("score"), pool.alias("member")) for n, (score, pool) in scorers.items()]
    long = df.select(target, truth, *key, F.explode(F.array(*entries)).alias("e")).select("*", "e.*").where("member AND score IS NOT NULL")
    ranked = long.withColumn("_at", place(["scorer", target], F.desc("score"), *map(F.asc, key)))
    each = ranked.groupBy("scorer", target).agg(
        F.count(F.lit(1)).alias("pool"), F.min(F.when(F.col("_at") == 1, F.col(truth))).alias("top1"), F.min(F.when(F.col("_at") <= 5, F.col(truth))).alias("best5")
    )
    return each.groupBy("scorer").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("pool"), 6).alias("mean_pool"), F.count_if(F.col("top1") < native).alias("top1_hits"),
        F.count_if(F.col("best5") < native).alias("best5_hits"), F.count_if(F.col("top1") < tight).alias("tight_hits"),
    )


def family_stats(df: DataFrame, family: str, truth: str, native: float, tight: float) -> DataFrame:
    """Per family: rows, natives and their percentage, tight ones, upper median and least truth."""
    found = df.where(F.col(truth).isNotNull()).groupBy(family).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col(truth) < native).alias("natives"), F.count_if(F.col(truth) < tight).alias("tight"), F.min(truth).alias("least")
    )
    middle = upper_medians(df, [family], [truth]).withColumnRenamed(truth, "median")
    return found.join(middle, family).withColumn("percent", percent(F.col("natives"), F.col("n")))


def family_recall(df: DataFrame, family: str, target: str, truth: str, native: float) -> DataFrame:
    """Per family: targets it has candidates of, and those with a native one."""
    best = df.groupBy(family, target).agg(F.min(truth).alias("best"))
    return best.groupBy(family).agg(F.count(F.lit(1)).alias("targets"), F.count_if(F.col("best") < native).alias("recalled"))


def picks_by_family(df: DataFrame, target: str, family: str, scorers: list[str], truth: str, key: list[str], native: float) -> DataFrame:
    """Where each scorer's first picks come from: picks, hits, share of the scorer's picks, hit rate."""
    long = df.select(target, family, truth, *key, F.explode(F.array(*[F.struct(F.lit(s).alias("scorer"), F.col(s).cast("double").alias("score")) for s in scorers])).alias("e"))
    first = long.select("*", "e.*").withColumn("_at", place(["scorer", target], F.desc_nulls_last("score"), *map(F.asc, key))).where("_at = 1")
    found = first.groupBy("scorer", family).agg(F.count(F.lit(1)).alias("picks"), F.count_if(F.col(truth) < native).alias("hits"))
    share = percent(F.col("picks"), F.sum("picks").over(Window.partitionBy("scorer")))
    return found.withColumns({"share": share, "hit_rate": percent(F.col("hits"), F.col("picks"))})


def empirical_cdf(df: DataFrame, group: list[str], value: str, key: list[str]) -> DataFrame:
    """Every value with i / n, its place among the sorted values of its group; ties follow the key."""
    rows = df.where(F.col(value).isNotNull())
    at = place(group, F.asc(value), *map(F.asc, key)) / F.count(F.lit(1)).over(Window.partitionBy(*group))
    return rows.select(*group, *key, value, F.round(at, 6).alias("cdf"))


def consensus_outcomes(df: DataFrame, target: str, family: str, truth: str, margin: float, native: float) -> DataFrame:
    """By the number of families within ``margin`` of a target's best: targets, natives and the rest (false alarms)."""
    best = df.groupBy(target, family).agg(F.min(truth).alias("best")).withColumn("low", F.min("best").over(Window.partitionBy(target)))
    each = best.groupBy(target).agg(F.count_if(F.col("best") <= F.col("low") + margin).alias("n_families"), F.min("low").alias("low"))
    found = each.groupBy("n_families").agg(F.count(F.lit(1)).alias("targets"), F.count_if(F.col("low") < native).alias("recovered"))
    return found.withColumns({"false_alarms": F.col("targets") - F.col("recovered"), "percent": percent(F.col("recovered"), F.col("targets"))})


def sampling_diagnosis(df: DataFrame, target: str, family: str, first: Column, truth: str, edges: list[float]) -> DataFrame:
    """By the family that holds a target's best and the half-open bin of that best: targets, and those that only one side rescues."""
    best = df.groupBy(target).agg(
        F.min_by(family, F.struct(truth, family)).alias("best_family"), F.min(truth).alias("best"), F.min(F.when(first, F.col(truth))).alias("a"), F.min(F.when(~first, F.col(truth))).alias("b")
    )
    level = sum(((F.col("best") >= e).cast("int") for e in edges[1:]), (F.col("best") >= edges[0]).cast("int"))
    hit = lambda c: F.coalesce(F.col(c) < edges[0], F.lit(False))
    return best.groupBy("best_family", level.alias("bin")).agg(
        F.count(F.lit(1)).alias("targets"), F.count_if(hit("a") & ~hit("b")).alias("first_rescues"), F.count_if(hit("b") & ~hit("a")).alias("second_rescues")
    )


def native_rates(df: DataFrame, family: list[str], truth: str, native: float, least: int) -> DataFrame:
    """Share of natives in families of at least ``least`` rows."""
    found = df.groupBy(*family).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(truth) < native).alias("natives"))
    return found.where(F.col("n") >= least).withColumn("rate", F.round(F.col("natives") / F.col("n"), 6))


def family_spreads(df: DataFrame, target: str, family: str, truth: str) -> DataFrame:
    """Per family: (target, family) groups of more than one row, the upper median and the largest of their max - min."""
    spread = df.groupBy(target, family).agg(F.count(truth).alias("n"), (F.max(truth) - F.min(truth)).alias("spread")).where("n > 1")
    found = spread.groupBy(family).agg(F.count(F.lit(1)).alias("groups"), F.max("spread").alias("widest"))
    return found.join(upper_medians(spread, [family], ["spread"]).withColumnRenamed("spread", "median"), family)


def gaps(outcomes: DataFrame, by: list[str], much: float) -> DataFrame:
    """From per-target top1, top5 and oracle, per group and whether the oracle is native: mean gaps and how many are wide."""
    rows = outcomes.withColumns({"to_oracle": F.col("top1") - F.col("oracle"), "to_top5": F.col("top1") - F.col("top5")})
    return rows.groupBy(*by, "oracle_native").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("to_oracle"), 6).alias("mean_to_oracle"), F.round(F.avg("to_top5"), 6).alias("mean_to_top5"), F.count_if(F.col("to_top5") > much).alias("wide")
    )


def tiers(df: DataFrame, value: Column, high: float, middle: float, counted: str) -> DataFrame:
    """Rows and distinct ``counted`` values per tier of a confidence."""
    tier = F.when(value >= high, "high").when(value >= middle, "middle").otherwise("low")
    return df.groupBy(tier.alias("tier")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(counted).alias("distinct"))


def value_counts(df: DataFrame, value: str) -> DataFrame:
    """How often each value occurs, with its place from the most frequent one on; one row per distinct value."""
    counted = df.groupBy(value).agg(F.count(F.lit(1)).alias("n"), F.lit(1).alias("_one"))
    return running(counted, "n", ["_one"], [value]).withColumn("place", (F.col("_one_before") + 1).cast("int")).drop("_one", "_one_before")


def headline(targets: DataFrame, cluster: str) -> DataFrame:
    """One row: clusters, size of the largest and its name, targets that are alone in theirs."""
    sizes = targets.groupBy(cluster).agg(F.count(F.lit(1)).alias("size"))
    return sizes.agg(
        F.count(F.lit(1)).alias("clusters"), F.max("size").alias("largest"), F.min_by(cluster, F.struct(-F.col("size"), F.col(cluster))).alias("largest_cluster"),
        F.count_if(F.col("size") == 1).alias("singletons"),
    )


def recoverable(outcomes: DataFrame, target: str, cluster: str, zone: str, most: int) -> DataFrame:
    """Targets with a native candidate that the first pick misses: one per cluster, at most ``most`` a zone, worst misses first."""
    missed = outcomes.where("oracle_native AND NOT top1_native").withColumn("miss", F.col("top1") - F.col("oracle"))
    one = missed.withColumn("_at", place([cluster], F.desc("miss"), F.asc(target))).where("_at = 1")
    return one.withColumn("rank", place([zone], F.desc("miss"), F.asc(target))).where(F.col("rank") <= most).select(zone, "rank", target, cluster, "miss")


def fair_ablation(df: DataFrame, target: str, strategies: dict[str, Column], subsets: dict[str, Column], truth: str, key: list[str], native: float) -> DataFrame:
    """Successes of strategies over the targets for which every strategy has a pick, per subset of targets."""
    entries = [F.struct(F.lit(n).alias("strategy"), c.cast("double").alias("score")) for n, c in strategies.items()]
    long = df.select(target, truth, *key, F.explode(F.array(*entries)).alias("e")).select("*", "e.*").where("score IS NOT NULL")
    first = long.withColumn("_at", place(["strategy", target], F.desc("score"), *map(F.asc, key))).where("_at = 1")
    fair = first.withColumn("_all", F.count(F.lit(1)).over(Window.partitionBy(target))).where(F.col("_all") == len(strategies))
    within = F.explode(F.array(*[F.when(c, F.lit(n)) for n, c in subsets.items()])).alias("subset")
    return fair.select("*", within).where("subset IS NOT NULL").groupBy("strategy", "subset").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(truth) < native).alias("hits"))


def group_rollup(df: DataFrame, group: str, distinct: str, best: list[str], flag: Column) -> DataFrame:
    """Per group: rows, distinct values, the largest of each metric, whether any row has the flag, and the place by the first metric."""
    found = df.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(distinct).alias("n_distinct"), *[F.max(b).alias(f"best_{b}") for b in best], F.max(flag.cast("int")).alias("flagged"))
    return found


def site_recall(df: DataFrame, source: str, distance: str, cutoff: float) -> DataFrame:
    """n, hits within ``cutoff`` (inclusive) and upper median per source and over all."""
    both = df.withColumn("_of", F.explode(F.array(F.col(source), F.lit("ALL"))))
    counts = both.groupBy("_of").agg(F.count(distance).alias("n"), F.count_if(F.col(distance) <= cutoff).alias("hits"))
    middle = upper_medians(both, ["_of"], [distance]).withColumnRenamed(distance, "median")
    return counts.join(middle, "_of").withColumnRenamed("_of", source)


def confidence(distance: Column) -> Column:
    """100 - 20 d, kept within 0 and 100; groups without distances have 50."""
    return F.when(distance.isNull(), 50.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100 - 20 * distance)))
