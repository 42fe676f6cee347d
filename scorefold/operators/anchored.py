"""Selections by exchange: a group's chosen rows are swapped until they cover what they must.

A group's state is one row of at most ``k`` chosen members. The candidates stay in their table: a round asks it for
the best one that a state can take (one row a group comes back), and a small function swaps members of each state.
So rounds are bounded by ``k`` and no group of candidates meets in one task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .contacts import nearest, pairs
from .lineage import settled
from .ranking import diverse_top_k, place
from .spatial import AXES


def _whole(vector: Column) -> Column:
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double"))), F.lit(False))


def _apart(vector: Column, members: Column, distance: float) -> Column:
    """Whether ``vector`` is at least ``distance`` from all members; exact copies count as apart, members without a vector too."""

    def far(member: Column) -> Column:
        squares = F.zip_with(vector, member["vector"], lambda a, b: (a.cast("double") - b) * (a.cast("double") - b))
        between = F.sqrt(F.aggregate(squares, F.lit(0.0), lambda total, x: total + x))
        return F.coalesce((between >= distance) | (between == 0) | F.isnan(between), F.lit(True))

    return F.forall(members, far)


def _each(states: DataFrame, change: Callable[[dict], dict], schema: StructType) -> DataFrame:
    """Applies ``change`` to every state, a row of its own."""
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pylist([change(row) for row in batch.to_pylist()], arrow)

    return states.mapInArrow(run, schema)


def _with(states: DataFrame, found: DataFrame, group: list[str], name: str) -> DataFrame:
    """States with the column ``name`` of ``found``, NULL for groups that it lacks."""
    renamed = found.select(*[F.col(g).alias(f"_{g}") for g in group], name)
    return states.join(renamed, _asked(group), "left").drop(*[f"_{g}" for g in group])


def _promote(k: int) -> Callable[[dict], dict]:
    """Anchors by weight: one that no member covers takes its best candidate, for the weakest member that may go."""

    def change(row: dict) -> dict:
        chosen, anchors = row["chosen"], row["anchors"]
        covers = lambda m, a: a["anchor"] in m["covers"]
        for a in sorted(anchors, key=lambda a: (-a["weight"], a["anchor"])):
            new = a["best"]
            if new is None or any(covers(m, a) for m in chosen):
                continue
            if len(chosen) < k:
                chosen.append(new)
                continue
            sole = [m for b in anchors if b is not a and len(c := [m for m in chosen if covers(m, b)]) == 1 for m in c]
            free = [m for m in chosen if not any(m is s for s in sole) and m["eff"] < new["eff"]]
            if free:
                weakest = min(free, key=lambda m: m["eff"])
                chosen[next(i for i, m in enumerate(chosen) if m is weakest)] = new
        return row | {"chosen": chosen}

    return change


def _strays(allowed: int | None) -> Callable[[dict], dict]:
    """Queues the members of lowest score that cover no anchor, beyond as many as are allowed."""

    def change(row: dict) -> dict:
        stray = [m for m in row["chosen"] if not m["covers"]] if row["anchors"] and allowed is not None else []
        drop = max(len(stray) - (allowed or 0), 0)
        return row | {"queue": [m["key"] for m in sorted(stray, key=lambda m: m["score"])[:drop]]}

    return change


def _replace(row: dict) -> dict:
    """The first of the queue goes for the candidate found, or stays, as do the others, if there is none."""
    row = dict(row)
    new = row.pop("best")
    if new is None:
        return row | {"queue": []}
    chosen = [new if m["key"] == row["queue"][0] else m for m in row["chosen"]]
    return row | {"chosen": chosen, "queue": row["queue"][1:]}


def _balance(k: int) -> Callable[[dict], dict]:
    """Sites in order: the first one with too few members that can take its candidate does; no such site ends the group."""
    least = 2 if k >= 4 else 1

    def change(row: dict) -> dict:
        row = dict(row)
        best = {b["site"]: b for b in row.pop("best") or []}
        chosen, count = row["chosen"], {}
        for m in chosen:
            count[m["site"]] = count.get(m["site"], 0) + 1
        for at in range(row["at"], len(row["sites"])):
            site = row["sites"][at]
            if count.get(site, 0) >= least or site not in best:
                continue
            free = [m for m in chosen if m["site"] is not None and count[m["site"]] > least]
            if free:
                weakest = min(free, key=lambda m: m["eff"])
                chosen[next(i for i, m in enumerate(chosen) if m is weakest)] = best[site]
            elif len(chosen) < k:
                chosen.append(best[site])
            else:
                continue
            return row | {"chosen": chosen, "at": at}
        return row | {"at": len(row["sites"])}

    return change


def anchored_top_k(
    poses: DataFrame, anchors: DataFrame, group: list[str], key: str, score: str, vector: str, heavy: str, k: int = 5, distance: float = 2.0,
    bonus: float = 0.15, decay: float = 6.0, cover: float = 8.0, gain: float = 1.5, sizes: tuple[int, int] = (15, 35), anchorless: int | None = 2,
    floor: float = 0.05, site: str = "template_site",
) -> DataFrame:
    """group, key, rank, effective: diverse poses of best score, exchanged so that anchors are covered.

    ``poses`` hold the centroid x, y, z and the number ``heavy`` of atoms, ``anchors`` anchor (unique in its group), x,
    y, z, weight and kind. A pose's effective score is its score plus ``bonus`` times weight and exp(-d / ``decay``) of
    the nearest anchor, more for large ligands (the first scored pose of a group tells its size).

    1. Walking by score, poses at least ``distance`` apart are chosen, up to ``k``; exact copies count as apart.
    2. An anchor without a member within ``cover``, heaviest first, takes the covering pose of highest effective
       score (score at least ``floor``), for the weakest weaker member that isn't the only cover of another anchor.
    3. While more than ``anchorless`` members cover no anchor, the one of lowest score goes for a covering pose apart
       from the others, one that covers the heaviest uncovered anchor first.
    4. With two or more anchors of the kind ``site``, each gets two members (one where k < 4) as far as poses apart from
       the others and members of richer sites allow.
    5. Members are ranked by effective score.

    Poses without a score take no part, those without finite x, y, z cover nothing and get no bonus; ties go by key.
    """
    low, high = sizes
    scored = poses.where(F.col(score).isNotNull()).select(*group, F.col(key).alias("key"), F.col(score).cast("double").alias("score"), F.col(vector).alias("vector"), F.col(heavy).alias("heavy"), *AXES)
    scored = scored.withColumn("key_", F.col("key")).transform(settled)
    placed = anchors.select(*group, F.col("anchor").alias("anchor"), F.col("weight").cast("double").alias("weight"), "kind", *AXES).transform(settled)
    named = placed.withColumn("key_", F.col("anchor"))
    size = scored.groupBy(*group).agg(F.min_by(F.coalesce("heavy", F.lit(low)), "key").alias("_heavy"))
    # one row a pose from each of these
    closest = nearest(scored, named, group, "key_", cover).select(*group, F.col("a").alias("key"), F.col("b").alias("anchor"), "distance")
    closest = closest.join(placed.select(*group, "anchor", "weight"), [*group, "anchor"]).drop("anchor")
    covering = pairs(scored, named, group, "key_", cover).groupBy(*group, F.col("a").alias("key")).agg(F.sort_array(F.collect_set("b")).alias("covers"))
    sites = placed.where(F.col("kind") == site)
    homes = nearest(scored, sites.withColumn("key_", F.col("anchor")), group, "key_", cover).select(*group, F.col("a").alias("key"), F.col("b").alias("site"))
    larger = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("_heavy") - low) / float(max(1, high - low))))
    raised = F.coalesce(bonus * (1 + gain * larger) * F.col("weight") * F.exp(-F.col("distance") / decay), F.lit(0.0))
    rows = scored.drop("key_", "heavy", *AXES)
    for more in (closest, covering, homes):
        rows = rows.join(more, [*group, "key"], "left")
    none = covering.schema["covers"].dataType
    rows = _with(rows, size, group, "_heavy").withColumns({"eff": F.col("score") + raised, "covers": F.coalesce("covers", F.array().cast(none))})
    rows = rows.select(*group, F.struct("key", "score", "eff", "vector", "covers", "site").alias("m")).transform(settled)

    flat = rows.select(*group, "m.key", "m.score", "m.vector")
    first = diverse_top_k(flat, group, "score", "vector", "key", k, distance, copies_apart=True).select(*group, "key", "rank")
    chosen = _members(rows, first, group)
    best = rows.where(F.col("m.score") >= floor).select(*group, F.explode("m.covers").alias("anchor"), "m")
    best = best.groupBy(*group, "anchor").agg(F.min_by("m", F.struct(-F.col("m.eff"), F.col("m.key"))).alias("best"))
    listed = placed.join(best, [*group, "anchor"], "left").groupBy(*group)
    listed = listed.agg(F.sort_array(F.collect_list(F.struct("anchor", "weight", "kind", "best"))).alias("anchors"))
    states = _with(chosen, listed, group, "anchors").withColumn("anchors", F.coalesce("anchors", F.array().cast(listed.schema["anchors"].dataType)))
    states = states.withColumn("queue", F.slice(F.transform("chosen", lambda m: m["key"]), 1, 0))
    states = _each(states, lambda row: _strays(anchorless)(_promote(k)(row)), states.schema).transform(settled)

    while states.where(F.size("queue") > 0).take(1):
        asking = states.where(F.size("queue") > 0)
        keep = F.filter("chosen", lambda m: m["key"] != F.col("queue")[0])
        asking = asking.select(*group, keep.alias("keep"), F.transform("chosen", lambda m: m["key"]).alias("taken"), "anchors")
        bare = F.filter("anchors", lambda a: ~F.exists("keep", lambda m: F.array_contains(m["covers"], a["anchor"])))
        asking = asking.withColumn("bare", bare).drop("anchors")
        pool = rows.where((F.col("m.score") >= floor) & (F.size("m.covers") > 0) & _whole(F.col("m.vector")))
        met = pool.join(asking.withColumnsRenamed({g: f"_{g}" for g in group}), _asked(group))
        free = met.where(~F.array_contains("taken", F.col("m.key")) & _apart(F.col("m.vector"), F.col("keep"), distance))
        heaviest = F.coalesce(F.array_max(F.transform(F.filter("bare", lambda a: F.array_contains(F.col("m.covers"), a["anchor"])), lambda a: a["weight"])), F.lit(0.0))
        found = free.groupBy(*group).agg(F.min_by("m", F.struct(-heaviest, -F.col("m.eff"), F.col("m.key"))).alias("best"))
        waiting = _with(states.where(F.size("queue") > 0), found, group, "best")
        states = states.where(F.size("queue") == 0).unionByName(_each(waiting, _replace, states.schema)).transform(settled)

    places = F.transform(F.filter("anchors", lambda a: a["kind"] == site), lambda a: a["anchor"])
    states = states.select(*group, "chosen", places.alias("sites")).withColumn("at", F.when((F.size("sites") >= 2) & F.lit(k >= 2), 0).otherwise(F.size("sites"))).transform(settled)
    open_ = F.col("at") < F.size("sites")
    while states.where(open_).take(1):
        asking = states.where(open_).select(*group, "chosen", F.transform("chosen", lambda m: m["key"]).alias("taken"))
        met = rows.where(F.col("m.site").isNotNull() & _whole(F.col("m.vector"))).join(asking.withColumnsRenamed({g: f"_{g}" for g in group}), _asked(group))
        free = met.where(~F.array_contains("taken", F.col("m.key")) & _apart(F.col("m.vector"), F.col("chosen"), distance))
        found = free.groupBy(*group, "m.site").agg(F.min_by("m", F.struct(-F.col("m.eff"), F.col("m.key"))).alias("best"))
        found = found.groupBy(*group).agg(F.collect_list("best").alias("best"))  # one a site
        changed = _each(_with(states.where(open_), found, group, "best"), _balance(k), states.schema)
        states = states.where(~open_).unionByName(changed).transform(settled)
    members = states.select(*group, F.posexplode("chosen").alias("_at", "m"))
    return members.select(*group, F.col("m.key").alias(key), place(group, F.desc("m.eff"), F.asc("_at")).alias("rank"), F.col("m.eff").alias("effective"))


def _asked(group: list[str]) -> Column:
    """Equality of the group with that of a table whose group columns begin with an underscore; NULL equals NULL."""
    same = F.lit(True)
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"_{g}"))
    return same


def _members(rows: DataFrame, ranked: DataFrame, group: list[str]) -> DataFrame:
    """group, chosen: the members (struct ``m``) of the rows that ``ranked`` (group, key, rank) names, in order."""
    renamed = ranked.select(*[F.col(g).alias(f"_{g}") for g in group], F.col("key").alias("_key"), F.col("rank").alias("_rank"))
    found = rows.join(renamed, _asked(group) & (F.col("m.key") == F.col("_key")))
    listed = found.groupBy(*group).agg(F.sort_array(F.collect_list(F.struct("_rank", "m"))).alias("_l"))
    return listed.select(*group, F.transform("_l", lambda s: s["m"]).alias("chosen"))


def _force(k: int) -> Callable[[dict], dict]:
    """Adds the candidate found; in a full set the weakest member goes that isn't the first nor safe, else any but the first."""

    def change(row: dict) -> dict:
        row = dict(row)
        new, chosen = row.pop("best"), row["chosen"]
        if new is None:
            return row | {"need": 0}
        if len(chosen) >= k:
            others = chosen[1:]
            free = [m for m in others if not m["safe"]] or others
            if not free:
                return row | {"need": 0}
            weakest = min(free, key=lambda m: m["score"])
            chosen = [m for m in chosen if m is not weakest]
        return row | {"chosen": [*chosen, new], "need": row["need"] - 1, "last": {"score": new["score"], "key": new["key"]}}

    return change


def forced_coverage(
    pool: DataFrame, chosen: DataFrame, group: list[str], key: str, score: str, vector: str, wanted: Column, quota: int, k: int = 5,
    distance: float | None = 2.0, safe: Column | None = None,
) -> DataFrame:
    """group, key, rank: the chosen rows (group, key, rank) with at least ``quota`` for which ``wanted`` holds, as far as there are such.

    Wanted rows of ``pool`` are walked by score, best first; one at least ``distance`` from all members (any one where it
    is None) is added, and in a full set the weakest member goes that is neither the first nor ``safe`` (as ``wanted``
    if not given), else the weakest but the first. Rows without a score or a whole vector aren't added; ties go by key.
    """
    no = lambda c: F.coalesce(c, F.lit(False))
    member = F.struct(F.col(key).alias("key"), F.col(score).cast("double").alias("score"), F.col(vector).alias("vector"), no(wanted).alias("hit"), no(wanted if safe is None else safe).alias("safe"))
    rows = pool.where(F.col(score).isNotNull()).select(*group, member.alias("m")).transform(settled)
    states = _members(rows, chosen.select(*group, F.col(key).alias("key"), "rank"), group)
    have = F.size(F.filter("chosen", lambda m: m["hit"]))
    none = F.struct(F.col("chosen")[0]["score"].alias("score"), F.col("chosen")[0]["key"].alias("key"))
    states = states.withColumns({"need": F.greatest(F.lit(0), quota - have), "last": F.when(F.lit(False), none)}).transform(settled)
    while states.where("need > 0").take(1):
        asking = states.where("need > 0").select(*[F.col(g).alias(f"_{g}") for g in group], "chosen", "last", F.transform("chosen", lambda m: m["key"]).alias("taken"))
        met = rows.where(F.col("m.hit") & _whole(F.col("m.vector"))).join(asking, _asked(group))
        later = F.col("last").isNull() | (F.col("m.score") < F.col("last.score")) | ((F.col("m.score") == F.col("last.score")) & (F.col("m.key") > F.col("last.key")))
        free = met.where(later & ~F.array_contains("taken", F.col("m.key")))
        if distance is not None:
            free = free.where(_apart(F.col("m.vector"), F.col("chosen"), distance))
        found = free.groupBy(*group).agg(F.min_by("m", F.struct(-F.col("m.score"), F.col("m.key"))).alias("best"))
        changed = _each(_with(states.where("need > 0"), found, group, "best"), _force(k), states.schema)
        states = states.where("need = 0").unionByName(changed).transform(settled)
    return states.select(*group, F.posexplode("chosen").alias("_at", "m")).select(*group, F.col("m.key").alias(key), (F.col("_at") + 1).alias("rank"))
