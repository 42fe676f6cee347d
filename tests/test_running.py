"""Clusterings whose centres move, against plain loops over all points."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from scorefold.operators import running, spatial
from scorefold.plans import exchange, registry

FOLDER = "/root/testdata/sf0.001"


def floor(a, b):
    return running.CONTACTS.get((a, b)) or running.CONTACTS.get((b, a)) or running.OTHER


def mean(points):
    return [sum(p[i] for p in points) / len(points) for i in range(3)]


def plain_first_match(points, radius):
    """Seeds of the points, in order."""
    clusters, out = [], []
    for n, p in enumerate(points, 1):
        hit = next((c for c in clusters if sum((a - b) ** 2 for a, b in zip(p, mean(c[1]), strict=True)) <= radius**2), None)
        if hit is None:
            clusters.append((n, [p]))
            out.append(n)
        else:
            hit[1].append(p)
            out.append(hit[0])
    return out


def clumps(seed, n, centres=12, width=40.0):
    rng = random.Random(seed)
    middle = [[rng.random() * width for _ in range(3)] for _ in range(centres)]
    return [("ab"[rng.random() < 0.3], i, *(c + rng.gauss(0, 1.6) for c in rng.choice(middle))) for i in range(n)]


def test_first_match_equals_a_plain_walk(spark):
    data = clumps(1, 500)
    df = spark.createDataFrame([*data, ("a", 1000, None, 0.0, 0.0), ("a", 1001, float("inf"), 0.0, 0.0)], "g string, id long, x double, y double, z double").repartition(3)
    found = running.first_match(df, ["g"], [F.asc("id")], 3.0)
    assert spatial.parts(df.where("id < 1000"), ["g"], 3.0).select("g", "_part").distinct().count() > 4
    got = {(r.g, r.id): (r.at, r.seed) for r in found.collect()}
    for g in "ab":
        mine = [r for r in data if r[0] == g]
        want = plain_first_match([r[2:] for r in mine], 3.0)
        assert {k: v for k, v in got.items() if k[0] == g} == {(g, r[1]): (n, s) for n, (r, s) in enumerate(zip(mine, want, strict=True), 1)}
    assert running.first_match(df.where("false"), ["g"], [F.asc("id")], 3.0).count() == 0


def test_the_registered_running_clusters_equal_a_plain_walk(spark):
    rows = [(r.label, r.vec_id, r.family, [r.x, r.y, r.z]) for r in exchange._points(spark, FOLDER).collect()]
    found = Counter((r.label, r.seed, r["size"], tuple(r.families), r.centre_x, r.centre_y, r.centre_z, r["rank"]) for r in registry.QUERIES["running_clusters"](spark, FOLDER).collect())
    want = Counter()
    for label in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == label), key=lambda r: r[1])
        clusters = {}
        for r, s in zip(mine, plain_first_match([r[3] for r in mine], 0.1), strict=True):
            clusters.setdefault(s, []).append(r)
        good = [(s, c) for s, c in clusters.items() if len(c) >= max(2, round(0.05 * len(mine)))]
        for rank, (s, c) in enumerate(sorted(good, key=lambda t: (-len(t[1]), t[0]))[:3], 1):
            want[label, s, len(c), tuple(sorted({r[2] for r in c})), *(round(v, 4) for v in mean([r[3] for r in c])), rank] += 1
    assert found == want and len(want) > 5


def plain_sites(points, scale):
    """Points (kind, donor, x, y, z) in order to sites before and after the repair: seed, centre, n, kind, donors."""
    sites, cells = [], {}
    top = lambda votes: Counter(votes).most_common(1)[0][0]
    for n, (kind, donor, *p) in enumerate(points, 1):
        cell = tuple(int(c // running.CELL) for c in p)
        near = [i for dx in (-1, 0, 1) for dy in (-1, 0, 1) for dz in (-1, 0, 1) for i in cells.get((cell[0] + dx, cell[1] + dy, cell[2] + dz), [])]
        near = [(math.dist(sites[i]["p"], p), i) for i in near]
        near = [(d, i) for d, i in near if d < scale * floor(top(sites[i]["votes"]), kind)]
        if not near:
            cells.setdefault(cell, []).append(len(sites))
            sites.append({"seed": n, "p": p, "n": 1, "votes": {kind: 1}, "donors": {donor}})
            continue
        s = sites[min(near, key=lambda t: t[0])[1]]
        s["n"] += 1
        s["p"] = [a + (b - a) / s["n"] for a, b in zip(s["p"], p, strict=True)]
        s["votes"][kind] = s["votes"].get(kind, 0) + 1
        s["donors"].add(donor)
    before = len(sites)
    while True:
        bad = sorted((d, i, j) for i, a in enumerate(sites) for j, b in enumerate(sites) if i < j and (d := math.dist(a["p"], b["p"])) < scale * floor(top(a["votes"]), top(b["votes"])))
        if not bad:
            return before, sites
        used, gone = set(), set()
        for _, i, j in bad:
            if used & {i, j}:
                continue
            used |= {i, j}
            keep, drop = (j, i) if sites[i]["n"] < sites[j]["n"] else (i, j)
            a, b = sites[keep], sites[drop]
            total = a["n"] + b["n"]
            a["p"] = [(x * a["n"] + y * b["n"]) / total for x, y in zip(a["p"], b["p"], strict=True)]
            for k, v in b["votes"].items():
                a["votes"][k] = a["votes"].get(k, 0) + v
            a["n"], a["donors"] = total, a["donors"] | b["donors"]
            gone.add(drop)
        sites = [s for i, s in enumerate(sites) if i not in gone]


@pytest.mark.parametrize("scale", [1.0, 1.3])
def test_solvent_sites_equal_a_plain_walk_and_keep_their_contacts(spark, scale):
    rng = random.Random(3)
    data = [(g, i, rng.choice(["HOH", "MG", "K", "NA", "CL"]), i % 6, *p) for g, i, *p in clumps(4, 420, 9, 22.0)]
    df = spark.createDataFrame(data, "g string, id long, kind string, donor long, x double, y double, z double").repartition(3)
    matched = running.nearest_site(df, ["g"], "kind", [F.asc("id")], scale)
    found = running.repaired(running.sites_of(matched, ["g"], "kind", "donor"), ["g"], scale).collect()
    for g in "ab":
        before, sites = plain_sites([r[2:] for r in data if r[0] == g], scale)
        mine = [r for r in found if r.g == g]
        want = {s["seed"]: ((s["n"], Counter(s["votes"]).most_common(1)[0][0], sorted(s["donors"])), pytest.approx(s["p"], abs=1e-6)) for s in sites}
        assert {r.site: ((r.n, r.kind, r.donors), [r.x, r.y, r.z]) for r in mine} == want
        assert before > len(sites) or g == "b"
        assert all(math.dist((a.x, a.y, a.z), (b.x, b.y, b.z)) >= scale * floor(a.kind, b.kind) for a in mine for b in mine if a.site < b.site)


def test_the_registered_sites_equal_plain_walks(spark):
    rows = [(r.label, r.vec_id, r.kind, r.donor, r.x, r.y, r.z) for r in exchange._solvent(spark, FOLDER).collect()]
    found = registry.QUERIES["solvent_sites"](spark, FOLDER).collect()
    pooled = registry.QUERIES["pooled_sites"](spark, FOLDER).collect()
    for label in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == label]
        _, sites = plain_sites([r[2:] for r in sorted(mine, key=lambda r: (r[3], r[1]))], 1.0)
        want = {s["seed"]: ((s["n"], len(s["donors"])), pytest.approx(s["p"], abs=2e-6)) for s in sites}
        assert {r.site: ((r.n, r.support), [r.x, r.y, r.z]) for r in found if r.label == label} == want
        pools = []
        for kind in sorted({r[2] for r in mine}):
            part = sorted((r for r in mine if r[2] == kind), key=lambda r: r[1])
            clusters = {}
            for r, s in zip(part, plain_first_match([r[4:] for r in part], 1.5), strict=True):
                clusters.setdefault(s, []).append(r)
            pools += [(-len({r[3] for r in c}), kind, s, mean([r[4:] for r in c])) for s, c in clusters.items() if len({r[3] for r in c}) >= 2]
        kept = []
        for n, (support, kind, _, p) in enumerate(sorted(pools), 1):
            if all(math.dist(p, q) >= floor(kind, k) + 0.005 for _, k, _, q in kept):
                kept.append((n, kind, -support, p))
        want = {n: ((k, s), pytest.approx(p, abs=2e-6)) for n, k, s, p in kept}
        assert {r.site: ((r.kind, r.support), [r.x, r.y, r.z]) for r in pooled if r.label == label} == want
    assert found and pooled
