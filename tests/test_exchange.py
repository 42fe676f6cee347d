"""Selections by exchange, clusters at cutoffs, folds and spread picks against plain loops."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from scorefold.operators import anchored, contacts, forest, greedy, spatial
from scorefold.plans import exchange, registry


def cloud(seed, n, groups="ab", spread=10.0):
    rng = random.Random(seed)
    return [(groups[i % len(groups)], i // len(groups), *(rng.random() * spread for _ in range(3))) for i in range(n)]


SCHEMA = "g string, id long, x double, y double, z double"


@pytest.mark.parametrize("small", [0, 5, 100_000])
def test_components_and_cutoffs_equal_a_plain_walk(spark, monkeypatch, small):
    monkeypatch.setattr(spatial, "SMALL", small)
    data = cloud(1, 120)
    df = spark.createDataFrame(data, SCHEMA)
    cutoffs = [0.5, 1.5, 2.5]
    found = {(r.g, r.id, r.cutoff): r.cluster for r in forest.single_link_cutoffs(df, ["g"], "id", cutoffs).collect()}
    single = {(r.g, r.id): r.cluster for r in spatial.single_link(df, ["g"], "id", 1.5).collect()}
    counts = []
    for c in cutoffs:
        label = {r[:2]: r[:2] for r in data}
        for p in data:
            for q in data:
                if p[0] == q[0] and math.dist(p[2:], q[2:]) <= c and label[p[:2]] != label[q[:2]]:
                    low, high = sorted((label[p[:2]], label[q[:2]]))
                    label = {k: low if v == high else v for k, v in label.items()}
        assert {k[:2]: v for k, v in found.items() if k[2] == c} == {k: v[1] for k, v in label.items()}
        counts.append(len(set(label.values())))
        if c == 1.5:
            assert single == {k: v[1] for k, v in label.items()}
    assert counts == sorted(counts, reverse=True) and counts[0] > counts[-1]


def test_keys_that_recur_between_groups(spark):
    a = [("A", 1, 0.0, 0.0, 0.0), ("A", 2, 1.0, 0.0, 0.0), ("A", 3, 50.0, 0.0, 0.0)]
    b = [("B", 1, 100.0, 0.0, 0.0), ("B", 2, 1.0, 0.0, 0.0), ("B", 3, 1.5, 0.0, 0.0)]
    df = spark.createDataFrame([(*r, i % 2) for i, r in enumerate(a + b)], f"{SCHEMA}, family int")
    clusters = Counter((r.g, r.id, r.cluster) for r in spatial.single_link(df, ["g"], "id", 1.0).collect())
    assert clusters == Counter({("A", 1, 1): 1, ("A", 2, 1): 1, ("A", 3, 3): 1, ("B", 1, 1): 1, ("B", 2, 2): 1, ("B", 3, 2): 1})
    seeds = {(r.g, r.id): r.seed for r in greedy.seeds(df, ["g"], "id", [F.col("id") != 2], 1.1).collect()}
    assert seeds == {("A", 1): 2, ("A", 2): 2, ("A", 3): 3, ("B", 1): 1, ("B", 2): 2, ("B", 3): 2}
    receptor = df.where("g = 'A'")
    assert {(r.g, r.id) for r in contacts.near_surface(df, receptor, ["g"], "id", 0.5).collect()} == {("A", 1), ("A", 2), ("A", 3)}
    found = contacts.clashing(df.withColumn("pose", F.lit(1)), receptor, ["g"], "pose", "id", 1.2, 1).collect()
    assert [(r.g, r.clashes) for r in found] == [("A", 5)]
    support = {(r.g, r.id): r.support for r in spatial.support(df, ["g"], "id", "family", 1.5).collect()}
    assert support == {("A", 1): 1, ("A", 2): 1, ("A", 3): 0, ("B", 1): 0, ("B", 2): 1, ("B", 3): 1}
    modes = {r.g: (r.id, r.mean_x) for r in spatial.density_mode(df, ["g"], "id", 1.0).collect()}
    assert modes == {"A": (1, 0.5), "B": (2, 1.25)}
    near = {(r.g, r.a): (r.b, r.distance) for r in contacts.nearest(df.where("id = 1"), df.where("id > 1"), ["g"], "id", 0.1).collect()}
    assert near == {("A", 1): (2, 1.0), ("B", 1): (3, 98.5)}


def plain_anchored(poses, anchors, k, distance, bonus, decay, cover, gain, sizes, anchorless, floor):
    """One group: poses (key, score, vector, centre, heavy), anchors (anchor, centre, weight, kind); the exchanges one by one."""
    poses = sorted((p for p in poses if p[1] is not None), key=lambda p: p[0])
    if not poses:
        return []
    share = max(0.0, min(1.0, ((poses[0][4] if poses[0][4] is not None else sizes[0]) - sizes[0]) / max(1, sizes[1] - sizes[0])))
    centre = {p[0]: p[3] if all(c is not None for c in p[3]) else None for p in poses}
    vector = {p[0]: p[2] for p in poses}
    score = {p[0]: p[1] for p in poses}
    anchors = sorted(anchors)
    eff, home = {}, {}
    sites = [a for a in anchors if a[3] == "template_site"]
    for p in poses:
        eff[p[0]] = p[1]
        if centre[p[0]] and anchors:
            d, a = min(((math.dist(centre[p[0]], a[1]), a) for a in anchors), key=lambda t: (t[0], t[1][0]))
            eff[p[0]] += bonus * (1 + gain * share) * a[2] * math.exp(-d / decay)
        if centre[p[0]] and sites:
            home[p[0]] = min((math.dist(centre[p[0]], a[1]), a[0]) for a in sites)[1]
    covers = lambda i, a: centre[i] is not None and math.dist(centre[i], a[1]) <= cover
    whole = lambda i: vector[i] is not None and all(v is not None for v in vector[i])

    def apart(i, others):
        return all(not whole(o) or (d := math.dist(vector[i], vector[o])) >= distance or d == 0 for o in others)

    chosen = []
    for i in sorted(score, key=lambda i: (-score[i], i)):
        if len(chosen) < k and (not chosen or (whole(i) and apart(i, chosen))):
            chosen.append(i)
    for a in sorted(anchors, key=lambda a: (-a[2], a[0])):
        near = [i for i in score if covers(i, a) and score[i] >= floor and i not in chosen]
        if any(covers(i, a) for i in chosen) or not near:
            continue
        new = min(near, key=lambda i: (-eff[i], i))
        if len(chosen) < k:
            chosen.append(new)
            continue
        alone = {c[0] for b in anchors if b != a and len(c := [i for i in chosen if covers(i, b)]) == 1}
        free = [i for i in chosen if i not in alone and eff[i] < eff[new]]
        if free:
            chosen[chosen.index(min(free, key=lambda i: eff[i]))] = new
    stray = [i for i in chosen if anchors and not any(covers(i, a) for a in anchors)]
    pool = [i for i in score if i not in chosen and score[i] >= floor and any(covers(i, a) for a in anchors)]
    for victim in sorted(stray, key=lambda i: score[i])[: max(len(stray) - anchorless, 0)]:
        keep = [i for i in chosen if i != victim]
        bare = [a for a in anchors if not any(covers(i, a) for i in keep)]
        order = sorted(pool, key=lambda i: (-max((a[2] for a in bare if covers(i, a)), default=0.0), -eff[i], i))
        new = next((i for i in order if whole(i) and apart(i, keep)), None)
        if new is None:
            break
        chosen[chosen.index(victim)] = new
        pool.remove(new)
    if len(sites) >= 2 and k >= 2:
        least = 2 if k >= 4 else 1
        for s in sites:
            while sum(home.get(i) == s[0] for i in chosen) < least:
                order = sorted((i for i in score if i not in chosen and home.get(i) == s[0]), key=lambda i: (-eff[i], i))
                new = next((i for i in order if whole(i) and apart(i, chosen)), None)
                if new is None:
                    break
                count = Counter(home.get(i) for i in chosen)
                free = [i for i in chosen if i in home and count[home[i]] > least]
                if free:
                    chosen[chosen.index(min(free, key=lambda i: eff[i]))] = new
                elif len(chosen) < k:
                    chosen.append(new)
                else:
                    break
    return [(i, n, pytest.approx(eff[i], abs=1e-5)) for n, i in enumerate(sorted(chosen, key=lambda i: -eff[i]), 1)]


def check_anchored(poses, anchors, found, options, group="g"):
    got = {}
    for r in found:
        got.setdefault(r[group], []).append((r[1], r["rank"], r.effective))
    for g in {p[0] for p in poses}:
        want = plain_anchored([p[1:] for p in poses if p[0] == g], [a[1:] for a in anchors if a[0] == g], **options)
        assert sorted(got.pop(g, []), key=lambda t: t[1]) == want, g
    assert not got


OPTIONS = {"k": 5, "distance": 2.0, "bonus": 0.15, "decay": 6.0, "cover": 2.5, "gain": 1.5, "sizes": (15, 35), "anchorless": 1, "floor": 0.05}


@pytest.mark.parametrize("k", [3, 5])
def test_anchored_selection_equals_the_exchanges_one_by_one(spark, k):
    rng = random.Random(k)
    poses, anchors = [], []
    for g in range(8):
        n = 12_000 if g == 0 else 150
        for i in range(n):
            p = [round(rng.random() * 12, 3) for _ in range(3)]
            score = None if rng.random() < 0.1 else round(rng.random(), 2)
            poses.append((f"g{g}", i, score, None if i % 31 == 3 else [*p[:2], None if i % 17 == 2 else p[2]], [None] * 3 if i % 29 == 5 else p, None if g == 3 else 12 + 4 * g))
        for a in range([3, 6, 0, 4, 9, 2, 1, 5][g]):
            anchors.append((f"g{g}", a, [rng.random() * 12 for _ in range(3)], 1 + a % 3 / 2, "template_site" if a % 2 == 0 else "residue"))
    poses += [("none", i, None, [0.0] * 3, [0.0] * 3, 1) for i in range(3)]
    df = spark.createDataFrame([(g, i, s, v, *c, h) for g, i, s, v, c, h in poses], "g string, id long, score double, v array<double>, x double, y double, z double, heavy int")
    places = spark.createDataFrame([(g, a, *c, w, kind) for g, a, c, w, kind in anchors], "g string, anchor int, x double, y double, z double, weight double, kind string")
    options = OPTIONS | {"k": k}
    found = anchored.anchored_top_k(df, places, ["g"], "id", "score", "v", "heavy", **options).collect()
    check_anchored(poses, anchors, found, options)


def test_the_registered_selection_equals_the_exchanges(spark):
    folder = "/root/testdata/sf0.001"
    poses = [(r.label, r.vec_id, r.score, r.point, [r.x, r.y, r.z], r.heavy) for r in exchange._poses(spark, folder).collect()]
    anchors = [(r.label, r.anchor, [r.x, r.y, r.z], r.weight, r.kind) for r in exchange._anchors(spark, folder).collect()]
    options = OPTIONS | {"distance": 0.15, "decay": 0.2, "cover": 0.12, "anchorless": 2}
    check_anchored(poses, anchors, registry.QUERIES["anchored_selection"](spark, folder).collect(), options, "label")


@pytest.mark.parametrize("distance", [None, 1.5])
def test_forced_coverage_equals_a_walk(spark, distance):
    rng = random.Random(2)
    pool = [("ab"[i % 2], i, None if i % 13 == 0 else round(rng.random(), 2), [rng.random() * 3 for _ in range(3)] if i % 9 else None, i % 5 == 0, i % 3 == 0) for i in range(160)]
    df = spark.createDataFrame(pool, "g string, id long, score double, v array<double>, hit boolean, safe boolean")
    first = {g: [p for p in sorted(pool, key=lambda p: -(p[2] or 0)) if p[0] == g and p[2] is not None and not p[4]][:4] for g in "ab"}
    chosen = spark.createDataFrame([(g, p[1], n) for g, ps in first.items() for n, p in enumerate(ps, 1)], "g string, id long, rank int")
    found = anchored.forced_coverage(df, chosen, ["g"], "id", "score", "v", F.col("hit"), 3, 5, distance, F.col("safe")).collect()
    for g, members in first.items():
        need = 3 - sum(p[4] for p in members)
        for c in sorted((p for p in pool if p[0] == g and p[4] and p[2] is not None and p[3]), key=lambda p: (-p[2], p[1])):
            near = distance is not None and any(m[3] and 0 < math.dist(c[3], m[3]) < distance for m in members)
            if need > 0 and not near and c not in members:
                if len(members) >= 5:
                    free = [m for m in members[1:] if not m[5]] or members[1:]
                    members = [m for m in members if m is not min(free, key=lambda m: m[2])]
                members = [*members, c]
                need -= 1
        assert [r.id for r in sorted((r for r in found if r.g == g), key=lambda r: r["rank"])] == [m[1] for m in members]
