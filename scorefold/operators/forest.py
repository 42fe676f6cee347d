"""Single-link clusters at several cutoffs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .spatial import single_link


def single_link_cutoffs(points: DataFrame, group: list[str], key: str, cutoffs: list[float]) -> DataFrame:
    """group, key, cutoff, cluster (its smallest key) of every point at each cutoff; keys may recur between groups.

    Each cutoff is clustered by itself: a forest of the shortest links would need all pairs within the largest one.
    """
    rows, out = points.select(*group, key, "x", "y", "z"), None
    for c in sorted(cutoffs):
        at = single_link(rows, group, key, c).select(*group, key, F.lit(float(c)).alias("cutoff"), "cluster")
        out = at if out is None else out.unionByName(at)
    return out
