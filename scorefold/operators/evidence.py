"""Merging and annotating evidence from several sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def merge_sources(parts: dict[str, DataFrame], keys: list[str], best: dict[str, str], first: list[str], ordinal: str) -> DataFrame:
    """Union of hit lists merged by key: one shuffle with map-side combining.

    ``best`` names for each metric max or min; ``first`` columns come from the row with the smallest
    (list, ordinal); a flag ``in_<source>`` tells which lists had the key.
    """
    rows = None
    for position, (name, df) in enumerate(parts.items()):
        tagged = df.withColumns({"_list": F.lit(position), "_name": F.lit(name)})
        rows = tagged if rows is None else rows.unionByName(tagged, allowMissingColumns=True)
    order = F.struct("_list", ordinal)
    kinds = {"max": F.max, "min": F.min}
    return rows.groupBy(*keys).agg(
        *[F.min_by(c, order).alias(c) for c in first],
        *[kinds[k](c).alias(c) for c, k in best.items()],
        *[F.max(F.when(F.col("_name") == n, 1).otherwise(0)).alias(f"in_{n}") for n in parts],
    )


def annotate(df: DataFrame, details: DataFrame, keys: list[str], fields: list[str], out: str) -> DataFrame:
    """Left join of a nested, sorted list of detail rows; rows without details get an empty list."""
    nested = details.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias(out))
    return df.join(nested, keys, "left").withColumn(out, F.coalesce(out, F.array().cast(nested.schema[out].dataType)))


def before(df: DataFrame, date: str, cutoff) -> DataFrame:
    """Rows dated before ``cutoff``; rows without a date stay."""
    return df.where(F.coalesce(F.col(date) < F.lit(cutoff), F.lit(True)))


def without_superseded(df: DataFrame, name: str, suffix_pattern: str) -> DataFrame:
    """Drops a name ``s`` if a name ``s`` + suffix exists."""
    longer = df.select(F.regexp_replace(name, suffix_pattern, "").alias("_base"), F.col(name).alias("_full")).where("_base != _full")
    return df.join(longer.select("_base").distinct(), F.col(name) == F.col("_base"), "left_anti")
