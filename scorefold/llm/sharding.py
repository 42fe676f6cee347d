"""Consistent hashing with virtual nodes and bounded loads.

Every shard owns ``vnodes`` points of a ring of 64-bit hashes; a row's key hashes to a place and goes
to the shard of the next point clockwise. A shard takes at most its capacity; rows beyond it, in the
order of their hash, continue clockwise to the next point of a shard with room. With ``epsilon`` 0 the
capacities are N/shards rounded so that they sum to N: counts differ by one at most. Rows between
two points of the ring are told apart by their rank only, so the walk is planned on the counts of the
ring's arcs, shards x vnodes rows whatever N is, and each row finds its shard by its rank in its arc.

Defined cases: null doc_id and null text have hashes as any value; rows that agree in doc_id and text
are told apart by nothing and share a place, each still gets its own slot; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialise, table

VNODES = 128


def mixed(values: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = values.astype(np.uint64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def ring(shards: int, vnodes: int = VNODES) -> tuple[np.ndarray, np.ndarray]:
    """Points in ascending order and the shard that owns each; a shard's points don't depend on the others."""
    shard = np.repeat(np.arange(shards, dtype=np.uint64), vnodes)
    number = np.tile(np.arange(vnodes, dtype=np.uint64), shards)
    points = mixed(mixed(shard * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1)) + number * np.uint64(0xD6E8FEB86659FD93)).view(np.int64)
    order = np.argsort(points, kind="stable")
    return points[order], shard[order].astype(np.int64)


def walk(counts: np.ndarray, owners: np.ndarray, capacity: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """(arc, first rank, end rank, shard, first slot): where the rows of each arc go.

    Rounds around the ring: in each, every arc's waiting rows ask the shard they have come to, and
    shards take rows arc by arc until full; the rest moves on to the next shard with room.
    """
    room = capacity.astype(np.int64).copy()
    used = np.zeros_like(room)
    n = len(owners)
    waiting = [(arc, arc, 0, int(c)) for arc, c in enumerate(counts) if c]  # place, arc, rank, end
    plan = []
    while waiting:
        later = []
        for place, arc, rank, end in sorted(waiting):
            shard = owners[place]
            taken = min(end - rank, int(room[shard]))
            if taken:
                plan.append((arc, rank, rank + taken, int(shard), int(used[shard])))
                room[shard] -= taken
                used[shard] += taken
            if rank + taken < end:
                later.append((place, arc, rank + taken, end))
        waiting = []
        for place, arc, rank, end in later:
            for step in range(1, n + 1):
                if room[owners[(place + step) % n]]:
                    waiting.append(((place + step) % n, arc, rank, end))
                    break
            else:
                raise ValueError("the capacities are smaller than the number of rows")
    return plan


def capacities(rows: int, shards: int, epsilon: float) -> np.ndarray:
    if epsilon == 0:
        return np.array([rows // shards + (s < rows % shards) for s in range(shards)])
    return np.full(shards, int(np.ceil((1 + epsilon) * rows / shards)))


def bounded_ring(df: DataFrame, keys: list[str], shards: int, vnodes: int = VNODES, epsilon: float = 0.0) -> DataFrame:
    """Adds shard and slot (gapless from 0 in each shard) to every row of ``df``."""
    spark = df.sparkSession
    points, owners = ring(shards, vnodes)

    @F.pandas_udf("int")
    def arc(place: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(points, place.to_numpy()) % len(points), dtype="int32")

    placed = materialise(df.withColumn("_place", F.xxhash64(*keys)).withColumn("_arc", arc("_place")), "ring-placed")
    # at most shards x vnodes counts
    found = {r["_arc"]: r["count"] for r in placed.groupBy("_arc").count().collect()}
    counts = np.array([found.get(a, 0) for a in range(len(points))])
    plan = walk(counts, owners, capacities(int(counts.sum()), shards, epsilon))
    moves = spark.createDataFrame(plan, "_arc int, _from bigint, _to bigint, shard int, _slot bigint")
    ranked = placed.withColumn("_rank", F.row_number().over(Window.partitionBy("_arc").orderBy("_place", *keys)) - 1)
    inside = (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to"))
    return (
        ranked.join(F.broadcast(moves), "_arc")  # a few rows per arc of the ring
        .where(inside)
        .withColumn("slot", F.col("_slot") + F.col("_rank") - F.col("_from"))
        .drop("_place", "_arc", "_from", "_to", "_slot", "_rank")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit("")).cast("binary")
    rows = table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text) + 16).cast("bigint").alias("size"), F.crc32(text).alias("text_crc32")
    )
    return bounded_ring(rows, ["doc_id", "text_crc32"], 40).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
