"""Distance gates between two sets of points of a group; pairs come from a grid of cells, never from a cross join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .lineage import settled
from .ranking import place
from .spatial import AXES


def pairs(left: DataFrame, right: DataFrame, group: list[str], key: str, radius: float, strict: bool = False) -> DataFrame:
    """group, a (key on the left), b (key on the right), distance of all pairs within ``radius``."""
    here = left.select(*group, F.col(key).alias("a"), *AXES, *[F.floor(F.col(c) / radius).alias(f"c{c}") for c in AXES])
    there = right.select(*group, F.col(key).alias("b"), *[F.col(c).alias(f"{c}2") for c in AXES], *[F.floor(F.col(c) / radius).alias(f"c{c}") for c in AXES])
    for c in AXES:
        there = there.withColumn(f"c{c}", F.explode(F.array(*[F.col(f"c{c}") + d for d in (-1, 0, 1)])))
    distance = F.sqrt(sum(((F.col(c) - F.col(f"{c}2")) ** 2 for c in AXES[1:]), (F.col("x") - F.col("x2")) ** 2))
    found = here.join(there, [*group, *[f"c{c}" for c in AXES]]).select(*group, "a", "b", distance.alias("distance"))
    return found.where(F.col("distance") < radius if strict else F.col("distance") <= radius)


def nearest(points: DataFrame, others: DataFrame, group: list[str], key: str, radius: float) -> DataFrame:
    """group, a, b, distance: the nearest of ``others`` (of equal ones the first key) to each point of a group that has any.

    A round looks within its radius and settles the points that find one there, exactly; the others go on with the
    radius doubled. So dense neighbourhoods are never widened, and rounds are as many as the doublings that the
    largest gap needs. Points and others without finite coordinates take no part.
    """
    whole = F.lit(True)
    for c in AXES:
        whole = whole & (F.abs(c) < float("inf"))
    others = others.where(whole).transform(settled)
    left = points.where(whole).join(others.select(*group).distinct(), group, "left_semi").select(*group, key, *AXES).transform(settled)
    found = []
    while left.take(1):
        best = pairs(left, others, group, key, radius).groupBy(*group, "a").agg(F.min(F.struct("distance", "b")).alias("m")).transform(settled)
        found.append(best.select(*group, "a", F.col("m.b").alias("b"), F.col("m.distance").alias("distance")))
        left = left.join(best.select(*group, F.col("a").alias(key)), [*group, key], "left_anti").transform(settled)
        radius *= 2
    if not found:
        return pairs(left, others, group, key, radius)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def near_surface(points: DataFrame, receptor: DataFrame, group: list[str], key: str, margin: float) -> DataFrame:
    """Points whose nearest receptor atom lies within ``margin``; all points where ``margin`` is 0."""
    if margin <= 0:
        return points
    return points.join(pairs(points, receptor, group, key, margin).select(*group, F.col("a").alias(key)).distinct(), [*group, key], "left_semi")


def clashing(atoms: DataFrame, receptor: DataFrame, group: list[str], pose: str, key: str, cutoff: float, least: int) -> DataFrame:
    """group, pose, clashes of the poses with ``least`` or more atom pairs closer than ``cutoff``; atom keys may recur between poses."""
    inside = F.struct(F.col(pose).alias("pose"), F.col(key).alias("key"))
    close = pairs(atoms.withColumn("_atom", inside), receptor.withColumn("_atom", F.col(key)), group, "_atom", cutoff, strict=True)
    counted = close.groupBy(*group, F.col("a.pose").alias(pose)).agg(F.count(F.lit(1)).alias("clashes"))
    return counted.where(F.col("clashes") >= least)


def without_overlaps(atoms: DataFrame, cofactors: DataFrame, group: list[str], pose: str, key: str, cutoff: float) -> DataFrame:
    """Atoms of the poses that have no atom closer than ``cutoff`` to a cofactor; group and pose must not be NULL."""
    return atoms.join(clashing(atoms, cofactors, group, pose, key, cutoff, 1), [*group, pose], "left_anti")


def host_chains(ligands: DataFrame, polymers: DataFrame, group: list[str], key: str, chain: str, cutoff: float) -> DataFrame:
    """group, key, host, contacts: the chain with most contacts (of equal ones the first), else the ligand's own and 0."""
    chains = polymers.select(*group, F.col(key).alias("b"), F.col(chain).alias("host"))
    counts = pairs(ligands, polymers, group, key, cutoff).select(*group, "a", "b").join(chains, [*group, "b"]).groupBy(*group, "a", "host").agg(F.count(F.lit(1)).alias("contacts"))
    best = counts.groupBy(*group, "a").agg(F.min(F.struct(-F.col("contacts"), F.col("host"))).alias("m"))
    best = best.select(*group, F.col("a").alias(key), F.col("m.host").alias("host"), (-F.col("m.col1")).alias("contacts"))
    return ligands.join(best, [*group, key], "left").select(*group, key, F.coalesce("host", chain).alias("host"), F.coalesce("contacts", F.lit(0)).alias("contacts"))


def own_protomers(pockets: DataFrame, group: list[str], template_chain: str, ligand_chain: str, names: list[str], key: str) -> DataFrame:
    """Pockets that lie on their template's chain, once per name, chain and point to one decimal; all of a group that would lose every one."""
    chain = lambda c: F.upper(F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))))
    t, o = chain(template_chain), chain(ligand_chain)
    kept = ~((t != "") & (o != "") & (t != o))
    whole = Window.partitionBy(*group)
    rounded = [F.bround(F.coalesce(F.col(a), F.lit(0.0)) * 10).alias(f"_{a}") for a in AXES]
    marked = pockets.withColumns({"_t": t, "_kept": kept, **{f"_{a}": r for a, r in zip(AXES, rounded, strict=True)}})
    marked = marked.withColumns({"_any": F.max("_kept").over(whole), "_at": place([*group, *names, "_t", "_x", "_y", "_z", "_kept"], F.asc(key))})
    return marked.where((F.col("_kept") & (F.col("_at") == 1)) | ~F.col("_any")).select(*pockets.columns)


def corroborated(entries: DataFrame, pockets: DataFrame, group: list[str], key: str, radius: float, least: int) -> DataFrame:
    """Entries with ``least`` or more pockets of other keys within ``radius``."""
    counted = pairs(entries, pockets, group, key, radius).where("a != b").groupBy(*group, F.col("a").alias(key)).agg(F.count(F.lit(1)).alias("near"))
    return entries.join(counted.where(F.col("near") >= least), [*group, key])
