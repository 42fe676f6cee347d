"""Selections that walk an order, found in rounds over all rows instead of row by row in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lineage import settled
from .ranking import diverse_top_k, place
from .spatial import AXES, neighbours
from .statistics import exact_quantiles


def seeds(points: DataFrame, group: list[str], key: str, order: list[Column], radius: float, strict: bool = True) -> DataFrame:
    """Every point with ``seed``, the key of the first kept point near it; a kept point has its own key.

    Walking each group in ``order`` (then by key), a point is kept if it isn't near one kept before. A round
    settles all points whose earlier neighbours are settled, so rounds are as many as the longest chain of
    points that wait for each other, and only waiting points and their links take part in the next one. Keys
    may recur between groups.
    """
    rows = points.withColumn("_o", F.struct(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], *[c.alias(f"_{i}") for i, c in enumerate(order)], F.col(key).alias("_k")))
    links = neighbours(rows, group, "_o", radius, strict).select("a", "b").transform(settled)
    waiting = rows.select("_o")
    kept, left = None, links
    while True:
        ahead = left.select(F.col("b").alias("_o")).distinct()
        free = waiting.join(ahead, "_o", "left_anti").transform(settled)
        if not free.take(1):
            break
        kept = free if kept is None else kept.unionByName(free)
        near = left.join(free, left.a == free._o, "left_semi").select(F.col("b").alias("_o")).distinct().transform(settled)
        waiting = waiting.join(free, "_o", "left_anti").join(near, "_o", "left_anti").transform(settled)
        left = left.join(waiting, left.a == waiting._o, "left_semi").join(waiting, left.b == waiting._o, "left_semi").transform(settled)
    if kept is None:
        return points.withColumn("seed", F.col(key))
    first = links.join(kept, links.a == kept._o, "left_semi").groupBy("b").agg(F.min("a").alias("_first"))
    # a kept point has no kept point before it
    named = rows.join(first, rows._o == first.b, "left")
    return named.select(*points.columns, F.coalesce("_first", "_o")["_k"].alias("seed"))


def seed_clusters(seeded: DataFrame, group: list[str]) -> DataFrame:
    """Size, mean point and spread (standard deviation of all coordinates together) of each seed's points."""
    axis = seeded.groupBy(*group, "seed").agg(F.count(F.lit(1)).alias("size"), *[F.avg(a).alias(f"m{a}") for a in AXES], *[F.var_pop(a).alias(f"v{a}") for a in AXES])
    mean = (F.col("mx") + F.col("my") + F.col("mz")) / 3
    within = (F.col("vx") + F.col("vy") + F.col("vz")) / 3
    between = sum(((F.col(f"m{a}") - mean) * (F.col(f"m{a}") - mean) for a in AXES[1:]), (F.col("mx") - mean) * (F.col("mx") - mean)) / 3
    return axis.select(*group, "seed", "size", *[F.round(f"m{a}", 6).alias(f"centre_{a}") for a in AXES], F.round(F.sqrt(within + between), 6).alias("spread"))


def cascaded_top_k(
    df: DataFrame, group: list[str], score: str, tie: str, favoured: Column, fallback: str, vector: str, key: str,
    k: int = 5, pool: int = 50, margin: float = 0.1, distance: float = 2.0,
) -> DataFrame:
    """group, key, rank: of the ``pool`` best scores, favoured ones raised by ``margin``, the ``k`` best that lie apart.

    Equal raised scores go by ``tie`` (NULL as 0), then by key. A group without any score gives its ``k`` best
    rows by ``fallback``, or its first ones where that is missing too; these need not lie apart.
    """
    top = df.where(F.col(score).isNotNull()).withColumn("_at", place(group, F.desc(score), F.asc(key))).where(F.col("_at") <= pool)
    raised = top.withColumn("_raised", F.col(score) + F.when(favoured, margin).otherwise(0.0))
    # one number that orders the pool as raised score, tie and key do
    ordered = raised.withColumn("_order", -place(group, F.desc("_raised"), F.desc(F.coalesce(tie, F.lit(0.0))), F.asc(key)).cast("double"))
    chosen = diverse_top_k(ordered, group, "_order", vector, key, k, distance).select(*group, key, "rank")
    scored = df.groupBy(*group).agg(F.max(score).alias("_any"), F.max(fallback).alias("_other"))
    same = [F.col(f"d.{g}").eqNullSafe(F.col(f"s.{g}")) for g in group]
    bare = df.alias("d").join(scored.where("_any IS NULL").alias("s"), same).where(F.col(fallback).isNotNull() | F.col("_other").isNull()).select("d.*")
    rest = bare.withColumn("rank", place(group, F.desc_nulls_last(fallback), F.asc(key))).where(F.col("rank") <= k)
    return chosen.unionByName(rest.select(*group, key, "rank"))


def quantile_picks(df: DataFrame, group: list[str], value: str, key: str, slots: dict[str, float]) -> DataFrame:
    """group, slot, key: for each slot in turn the row nearest to its quantile, rows not yet taken first.

    A slot can only take one of the rows nearest to it, as many as there are slots, so the walk over the
    slots has a bounded number of rows of each group.
    """
    names = list(slots)
    rows = df.where(F.col(value).isNotNull()).select(*group, key, value)
    aims = exact_quantiles(rows, group, value, slots).select(*group, F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(n).alias("aim")) for i, n in enumerate(names)])).alias("_s"))
    aims = aims.select(*group, F.col("_s.i").alias("_i"), F.col("_s.aim").alias("_aim"))
    # one row a group and slot
    away = rows.join(aims, group).withColumn("_far", F.round(F.abs(F.col(value) - F.col("_aim")), 9))
    near = away.withColumn("_at", place([*group, "_i"], F.asc("_far"), F.asc(key))).where(F.col("_at") <= len(names))
    lists = near.groupBy(*group).agg(F.sort_array(F.collect_list(F.struct("_i", "_at", F.col(key).alias("k")))).alias("_near"))
    none = F.slice(F.transform("_near", lambda c: c["k"]), 1, 0)

    def take(taken: Column, slot: Column) -> Column:
        own = F.filter("_near", lambda c: c["_i"] == slot)
        free = F.filter(own, lambda c: ~F.array_contains(taken, c["k"]))
        return F.concat(taken, F.array(F.coalesce(F.get(free, F.lit(0)), F.get(own, F.lit(0)))["k"]))

    taken = F.aggregate(F.array(*[F.lit(i) for i in range(len(names))]), none, take)
    picked = lists.select(*group, F.posexplode(taken).alias("_i", key))
    return picked.select(*group, F.element_at(F.array(*map(F.lit, names)), F.col("_i") + 1).alias("slot"), key)
