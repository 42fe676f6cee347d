"""Distribution and agreement statistics per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .ranking import average_ranks


def exact_quantiles(df: DataFrame, group: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Linearly interpolated quantiles per group, under the names of ``shares``; NULLs don't count.

    Equal values are counted first and the counts added up in order, so no group is held in memory.
    """
    counted = df.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count(F.lit(1)).alias("_c"))
    whole = Window.partitionBy(*group)
    upto = counted.withColumns({"_upto": F.sum("_c").over(whole.orderBy(value)), "_n": F.sum("_c").over(whole)})
    at = lambda place: F.min(F.when(F.col("_upto") > place, F.col(value).cast("double")))
    ends = []
    for name, share in shares.items():
        place = share * (F.col("_n") - 1)
        ends += [at(F.floor(place)).alias(f"_{name}_a"), at(F.ceil(place)).alias(f"_{name}_b"), F.max(place - F.floor(place)).alias(f"_{name}_f")]
    found = upto.groupBy(*group).agg(*ends)
    between = lambda n: F.col(f"_{n}_a") + (F.col(f"_{n}_b") - F.col(f"_{n}_a")) * F.col(f"_{n}_f")
    return found.select(*group, *[between(n).alias(n) for n in shares])


def spread(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """n, population deviation, range, median and interquartile range of groups of more than one value."""
    found = df.groupBy(*group).agg(
        F.count(value).alias("n"), F.round(F.stddev_pop(value), 6).alias("deviation"), F.round(F.max(value) - F.min(value), 6).alias("range")
    )
    q = exact_quantiles(df, group, value, {"q1": 0.25, "q2": 0.5, "q3": 0.75})
    return found.where("n > 1").join(q, group).select(*group, "n", "deviation", "range", F.round("q2", 6).alias("median"), F.round(F.col("q3") - F.col("q1"), 6).alias("iqr"))


def spearman(df: DataFrame, group: list[str], a: str, b: str, least: int = 5) -> DataFrame:
    """Rank correlation per group with tie-averaged ranks; NULL without variance."""
    rows = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    ranked = average_ranks(average_ranks(rows, group, a, "_ra"), group, b, "_rb")
    rho = F.when((F.var_pop("_ra") > 0) & (F.var_pop("_rb") > 0), F.round(F.corr("_ra", "_rb"), 6))
    return ranked.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), rho.alias("rho")).where(F.col("n") >= least)


def right_bins(value: Column, edges: list[float]) -> Column:
    """Index of the bin of fixed edges that are closed on the right and open on the left, the first one too; outside is NULL."""
    found = F.lit(None).cast("int")
    for i, (low, high) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        found = F.when((value > low) & (value <= high), F.lit(i)).otherwise(found)
    return found


def bins(value: Column, edges: list[float]) -> Column:
    """Index of the half-open bin of fixed edges; the last bin holds its right edge; outside is NULL."""
    found = F.lit(None).cast("int")
    for i, (low, high) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        top = value <= high if i == len(edges) - 2 else value < high
        found = F.when((value >= low) & top, F.lit(i)).otherwise(found)
    return found


def contribution(df: DataFrame, row: str, column: str) -> DataFrame:
    """Long cross table: counts and each cell's percentage of its row."""
    counts = df.groupBy(row, column).agg(F.count(F.lit(1)).alias("n"))
    share = 100 * F.col("n") / F.sum("n").over(Window.partitionBy(row))
    return counts.withColumn("percent", F.round(share, 6))


def ensemble(df: DataFrame, group: list[str], a: str, b: str, gate: Column) -> DataFrame:
    """Mean of the medians of ``a`` and of the gated ``b``, of whichever exist."""
    gated = df.withColumn("_gated", F.when(gate, F.col(b)))
    first, second = exact_quantiles(df, group, a, {"ma": 0.5}), exact_quantiles(gated, group, "_gated", {"mb": 0.5})
    found = df.select(*group).distinct().join(first, group, "left").join(second, group, "left")
    both = F.coalesce((F.col("ma") + F.col("mb")) / 2, "ma", "mb")
    return found.select(*group, F.round("ma", 6).alias("median_a"), F.round("mb", 6).alias("median_b"), F.round(both, 6).alias("ensemble"))


def affinities(df: DataFrame, group: list[str], a: str, b: str, gate: Column) -> DataFrame:
    """``ensemble`` of decimal logarithms with the affinity itself, 10 to its power; NULL where neither median exists."""
    return ensemble(df, group, a, b, gate).withColumn("affinity", F.round(F.pow(F.lit(10.0), F.col("ensemble")), 6))


def seeded_sample(df: DataFrame, group: list[str], key: str, k: int, seed: int) -> DataFrame:
    """``k`` rows of each group, or all: those that come first by a hash of seed and key, so a sample is the same each time."""
    drawn = F.sha2(F.concat_ws("/", F.lit(str(seed)), F.col(key).cast("string")), 256)
    return df.withColumn("_at", F.row_number().over(Window.partitionBy(*group).orderBy(drawn, key))).where(F.col("_at") <= k).drop("_at")


def cluster_statistics(members: DataFrame, group: list[str], cluster: str, top: int = 10) -> DataFrame:
    """group, n, clusters, singletons, multiple, largest (the ``top`` sizes, largest first), reduction (clusters a row)."""
    sizes = members.groupBy(*group, cluster).agg(F.count(F.lit(1)).alias("size"))
    # sizes that occur, with how often: the largest ones of few numbers
    ranked = sizes.withColumn("_at", F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("size"), cluster)))
    first = ranked.where(F.col("_at") <= top).groupBy(*group).agg(F.sort_array(F.collect_list("size"), False).alias("largest"))
    whole = sizes.groupBy(*group).agg(F.sum("size").alias("n"), F.count(F.lit(1)).alias("clusters"), F.count_if(F.col("size") == 1).alias("singletons"))
    counted = whole.join(first, group).withColumns({"multiple": F.col("clusters") - F.col("singletons"), "reduction": F.round(F.col("clusters") / F.col("n"), 6)})
    return counted.select(*group, "n", "clusters", "singletons", "multiple", F.array_join("largest", ";").alias("largest"), "reduction")


def quantiles(df: DataFrame, group: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Linearly interpolated quantiles per group, under the names of ``shares``."""
    found = exact_quantiles(df, group, value, shares)
    return found.select(*group, *[F.round(name, 6).alias(name) for name in shares])


def signal_rollup(df: DataFrame, group: list[str], score: str, other: str, key: list[str], least: float, top: int = 10) -> DataFrame:
    """Best, 90 % quantile, mean, mean of the ``top`` best, share at or above ``least``, and ``other`` at the best row.

    The sums combine map-side; the ranked part keeps ``top`` rows a group before it is shuffled.
    Means are taken of decimals with nine places, so they don't depend on the order of the rows.
    """
    mean = lambda c: F.round(F.avg(c.cast("decimal(20,9)")), 6).cast("double")
    rows = df.where(F.col(score).isNotNull())
    whole = rows.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n"),
        F.max(score).alias("best"),
        mean(F.col(score)).alias("mean"),
        F.round(F.avg((F.col(score) >= least).cast("double")), 6).alias("share"),
    )
    order = Window.partitionBy(*group).orderBy(F.desc(score), *map(F.asc, key))
    ranked = rows.select(*group, score, other, F.row_number().over(order).alias("_at")).where(F.col("_at") <= top)
    leading = ranked.groupBy(*group).agg(
        mean(F.col(score)).alias("top_mean"), F.max(F.when(F.col("_at") == 1, F.col(other))).alias("other_at_best")
    )
    high = exact_quantiles(rows, group, score, {"p90": 0.9}).withColumn("p90", F.round("p90", 6))
    return whole.join(high, group).join(leading, group)


def families_within(df: DataFrame, group: list[str], family: str, truth: str, margins: list[int]) -> DataFrame:
    """Per group, how many families have their best value within each margin of the group's best."""
    best = df.groupBy(*group, family).agg(F.min(truth).alias("best"))
    low = best.withColumn("low", F.min("best").over(Window.partitionBy(*group)))
    return low.groupBy(*group).agg(*[F.count_if(F.col("best") <= F.col("low") + m).alias(f"within_{m}") for m in margins])


def majority(df: DataFrame, group: list[str], value: str, ordinal: str) -> DataFrame:
    """Most common value per group; of equally common ones that which was seen first."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count(F.lit(1)).alias("n"), F.min(ordinal).alias("first"))
    order = Window.partitionBy(*group).orderBy(F.desc("n"), "first")
    return counts.withColumn("_at", F.row_number().over(order)).where("_at = 1").select(*group, value, "n")


def cluster_sizes(members: DataFrame, cluster: str) -> DataFrame:
    """(size, clusters of that size, clusters of at least that size).

    The running sum is over the distinct sizes only, fewer than the square root of twice the rows.
    """
    sizes = members.groupBy(cluster).agg(F.count(F.lit(1)).alias("size"))
    counted = sizes.groupBy("size").agg(F.count(F.lit(1)).alias("clusters"))
    return counted.withColumn("at_least", F.sum("clusters").over(Window.orderBy(F.desc("size"))))


def runs(df: DataFrame, group: list[str], value: str, order: list[str]) -> DataFrame:
    """Values that occur in more than one run of their group's order, with the number of runs."""
    before = F.lag(value).over(Window.partitionBy(*group).orderBy(*order))
    starts = df.withColumn("_start", F.when(before == F.col(value), 0).otherwise(1))
    return starts.groupBy(*group, value).agg(F.sum("_start").alias("runs")).where("runs > 1")
