"""Joins that assemble one table of candidates from several files, and the filters around them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .ranking import place


def first_per_name(df: DataFrame, name: str, ordinal: list[str]) -> DataFrame:
    """One row per name, the first by ``ordinal``."""
    return df.withColumn("_at", place([name], *map(F.asc, ordinal))).where("_at = 1").drop("_at")


def collect_outer(left: DataFrame, right: DataFrame, name: str, ordinal: list[str]) -> DataFrame:
    """Full outer join of two score files by name; of repeated names the first counts."""
    a, b = (first_per_name(df, name, ordinal).drop(*ordinal) for df in (left, right))
    return a.join(b, name, "full_outer")


def with_confidence(poses: DataFrame, confidence: DataFrame, keys: list[str], own: Column, inherits: Column, anchor: Column, values: list[str]) -> DataFrame:
    """Poses that have an ``own`` confidence get it by ``keys``, those that ``inherit`` get the anchor row's, others NULL."""
    found = poses.join(confidence.select(*keys, *values), keys, "left")
    # one row: the first confidence that is an anchor
    shared = confidence.where(anchor).agg(*[F.min_by(v, F.struct(*keys)).alias(f"_{v}") for v in values])
    both = found.join(F.broadcast(shared), F.lit(True), "left")
    return both.withColumns({v: F.when(own, F.col(v)).when(inherits, F.col(f"_{v}")) for v in values}).drop(*[f"_{v}" for v in values])


def assemble(index: DataFrame, scores: dict[str, DataFrame], key: str, value: str) -> DataFrame:
    """The index with one column per scorer, NULL where a scorer doesn't know the row."""
    for name, df in scores.items():
        index = index.join(df.select(key, F.col(value).alias(name)), key, "left")
    return index


def truth_with_fallback(picks: DataFrame, truth: DataFrame, exact: list[str], loose: list[str], value: str, ordinal: list[str]) -> DataFrame:
    """The truth of the exact key, else the first one of the loose key."""
    one = truth.groupBy(*exact).agg(F.min_by(value, F.struct(*ordinal)).alias("_exact"))
    any_ = truth.groupBy(*loose).agg(F.min_by(value, F.struct(*ordinal)).alias("_loose"))
    return picks.join(one, exact, "left").join(any_, loose, "left").withColumn(value, F.coalesce("_exact", "_loose")).drop("_exact", "_loose")


def matched_or_nearest(rows: DataFrame, refs: DataFrame, group: str, code: str, size: str, key: str) -> DataFrame:
    """Every row with the first reference of its group and code, else the one of the group that is nearest in size."""
    named = refs.select(group, F.col(code).alias("_code"), F.col(size).alias("_size"), F.col(key).alias("ref"))
    kinds = named.groupBy(group, "_code", "_size").agg(F.min("ref").alias("ref"))
    same = kinds.groupBy(group, "_code").agg(F.min("ref").alias("_same")).withColumnRenamed("_code", code)
    order = F.struct(F.abs(F.col(size) - F.col("_size")), F.col("ref"))
    sizes = rows.select(group, size).distinct()
    near = sizes.join(kinds, group).groupBy(group, size).agg(F.min_by("ref", order).alias("_near"))
    return rows.join(same, [group, code], "left").join(near, [group, size], "left").withColumn("ref", F.coalesce("_same", "_near")).drop("_same", "_near")


def representative_hits(members: DataFrame, hits: DataFrame, cluster: str, key: str, weight: str) -> DataFrame:
    """Per cluster the heaviest member that is among the hits."""
    return members.join(hits, key).withColumn("_at", place([cluster], F.desc(weight), F.asc(key))).where("_at = 1").drop("_at")


def rank_zip(lists: DataFrame, group: str, item: str, rank: str, items: list[str], value: str) -> DataFrame:
    """Models 1, 2, ... of the items of equal rank, up to the first model in which an item is missing."""
    wide = lists.groupBy(group, rank).agg(*[F.min(F.when(F.col(item) == i, F.col(value))).alias(f"{value}_{i}") for i in items])
    whole = F.when(sum((F.col(f"{value}_{i}").isNull().cast("int") for i in items[1:]), F.col(f"{value}_{items[0]}").isNull().cast("int")) > 0, 1).otherwise(0)
    before = Window.partitionBy(group).orderBy(rank)
    ok = wide.withColumns({"_broken": F.sum(whole).over(before), "_n": F.row_number().over(before)})
    return ok.where((F.col("_broken") == 0) & (F.col("_n") == F.col(rank))).drop("_broken", "_n")


def lowest_seeds(df: DataFrame, source: str, seed: str, key: list[str]) -> DataFrame:
    """Of every source the row with the lowest seed, and all rows without one."""
    at = place([source, F.col(seed).isNull()], F.asc(seed), *map(F.asc, key))
    return df.withColumn("_at", at).where((F.col("_at") == 1) | F.col(seed).isNull()).drop("_at")


def with_fallback(df: DataFrame, group: list[str], wanted: Column) -> DataFrame:
    """The wanted rows of every group, or all of a group that has none."""
    any_ = F.max(F.coalesce(wanted, F.lit(False))).over(Window.partitionBy(*group))
    return df.withColumn("_any", any_).where(wanted | ~F.col("_any")).drop("_any")


def chunk(df: DataFrame, group: list[str], order: list[str], chunks: int, stride: int) -> DataFrame:
    """Adds the row's chunk (its place modulo ``chunks``) and whether it's one of every ``stride``-th."""
    at = place(group, *map(F.asc, order)) - 1
    return df.withColumns({"chunk": (at % chunks).cast("int"), "strided": at % stride == 0})


def canonical_names(names: DataFrame, staged: DataFrame, name: str, stem: str) -> DataFrame:
    """Adds ``canonical``: the longest prefix of whole tokens that is staged, with the number that follows it.

    Tokens are parted by underscores. A name that is staged itself, or none of whose prefixes is, stays as it is;
    after a shorter prefix the next token is kept if it is a number, else 0 stands for it. Prefixes meet the
    staged names in one join, so neither side has to be small.
    """
    tokens = F.split(name, "_")
    known = staged.select(F.col(stem).alias("_prefix")).distinct()
    numbered = names.select(name).distinct().withColumn("_at", F.explode(F.sequence(F.lit(1), F.size(tokens))))
    hits = numbered.withColumn("_prefix", F.array_join(F.slice(tokens, F.lit(1), F.col("_at")), "_")).join(known, "_prefix")
    longest = hits.groupBy(name).agg(F.max("_at").alias("_at"))
    following = F.get(tokens, F.col("_at"))
    number = F.when(following.rlike("^[0-9]+$"), following).otherwise("0")
    short = F.concat_ws("_", F.array_join(F.slice(tokens, F.lit(1), F.col("_at")), "_"), number)
    return names.join(longest, name, "left").withColumn("canonical", F.when(F.col("_at") < F.size(tokens), short).otherwise(F.col(name))).drop("_at")
