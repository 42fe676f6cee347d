"""Spread picks, budgets, frames and canonical names against plain loops."""

import math
import random
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from scorefold.operators import assembly, running, spread, superposition
from scorefold.plans import exchange, registry

FOLDER = "/root/testdata/sf0.001"


def vectors(seed, n, dim=4):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim)) * [3, 1, 1, 0.1][:dim]
    x[n // 2] = x[0]  # copies
    return [("ab"[i % 3 == 0], i, x[i].tolist()) for i in range(n)]


@pytest.mark.parametrize("block", [8, 512])
def test_farthest_pair_and_split_equal_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(spread, "BLOCK", block)
    data = vectors(1, 260)
    rows = [*data, ("alone", 1, [0.0] * 4), ("same", 1, [1.0] * 4), ("same", 2, [1.0] * 4), ("a", 900, None), ("a", 901, [None] * 4), ("a", 902, [float("nan")] * 4)]
    df = spark.createDataFrame(rows, "g string, id long, v array<double>").withColumn("main", F.col("id") % 50 == 7).repartition(3)
    found = {r.g: (r.a, r.b, r.distance) for r in spread.farthest_pair(df, ["g"], "id", "v").collect()}
    sides = {(r.g, r.id): (r.side, r.apart) for r in spread.split_by_farthest(df, ["g"], "id", "v", "main").collect()}
    assert found.pop("same") == (1, 2, 0.0) and "alone" not in found
    assert sides["alone", 1] == (1, 0.0) and sides["same", 2] == (1, 0.0)
    for g in "ab":
        mine = {i: v for h, i, v in data if h == g}
        want = min((-math.dist(mine[i], mine[j]), i, j) for i in mine for j in mine if i < j)
        assert found[g] == (*want[1:], pytest.approx(-want[0]))
        side = {i: 1 if math.dist(v, mine[want[1]]) <= math.dist(v, mine[want[2]]) else 2 for i, v in mine.items()}
        home = side[min(i for i in mine if i % 50 == 7)]
        assert {k[1]: v[0] for k, v in sides.items() if k[0] == g} == {i: 1 if s == home else 2 for i, s in side.items()}
    assert spread.farthest_pair(df.where("false"), ["g"], "id", "v").count() == 0


def test_medoid_and_farthest_points_equal_a_plain_loop(spark):
    data = vectors(2, 300)
    df = spark.createDataFrame([*data, ("alone", 5, [0.0] * 4)], "g string, id long, v array<double>").repartition(3)
    found = {}
    for r in spread.farthest_points(df, ["g"], "id", "v", 5).collect():
        found.setdefault(r.g, []).append((r["rank"], r.id, r.apart))
    assert found["alone"] == [(1, 5, None)]
    for g in "ab":
        mine = {i: v for h, i, v in data if h == g}
        picks = [min(mine, key=lambda i: (round(np.mean([math.dist(mine[i], v) for v in mine.values()]), 12), i))]
        while len(picks) < 5:
            picks.append(max((i for i in mine if i not in picks), key=lambda i: (min(math.dist(mine[i], mine[p]) for p in picks), -i)))
        want = [(n, i, pytest.approx(min(math.dist(mine[i], mine[p]) for p in picks if p != i))) for n, i in enumerate(picks, 1)]
        assert sorted(found[g]) == want
    assert spread.farthest_points(df.where("false"), ["g"], "id", "v", 3).count() == 0


@pytest.mark.parametrize("block", [8, 4096])
def test_copies_meet_once_and_the_first_of_them_is_picked(spark, monkeypatch, block):
    monkeypatch.setattr(spread, "BLOCK", block)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(60, 16))
    x /= np.linalg.norm(x, axis=1)[:, None]
    mine = {n * 60 + i: x[i].tolist() for n in range(50) for i in range(60)}
    df = spark.createDataFrame([("g", i, v) for i, v in mine.items()], "g string, id long, v array<double>").repartition(7)
    far = np.linalg.norm(x[:, None] - x, axis=2)
    a, b = divmod(int(np.triu(far).argmax()), 60)
    pair = spread.farthest_pair(df, ["g"], "id", "v").first()
    assert (pair.a, pair.b, pair.distance) == (a, b, pytest.approx(far[a, b]))
    medoid = spread.medoids(df, ["g"], "id", "v").first()
    assert (medoid.id, medoid["mean"]) == (int(far.mean(1).argmin()), pytest.approx(far.mean(1).min()))


def test_cells_hold_a_tile_of_distances(monkeypatch):
    """Two parts of 3000 rows have 9 million distances; no more than a tile of them is made at once."""
    seen = []
    monkeypatch.setattr(spread, "_squares", lambda a, b, plain=spread._squares: seen.append(len(a) * len(b)) or plain(a, b))
    rng = np.random.default_rng(6)
    sides = [pa.table({"key": np.arange(3000) + 3000 * n, "v": pa.array(list(rng.normal(size=(3000, 3)))), "n": np.ones(3000)}) for n in range(2)]
    a, b = (np.array(s["v"].to_pylist()) for s in sides)
    far = np.linalg.norm(a[:, None] - b, axis=2)
    i, j = divmod(int(far.argmax()), 3000)
    assert spread._best_pair(*sides).to_pylist() == [{"a": i, "b": 3000 + j, "distance": pytest.approx(far.max())}]
    assert np.array(spread._sums(False)(*sides)["sum"]) == pytest.approx(far.sum(1)) and max(seen) <= 256 * 2048


def plain_budget(sites, count, spacing, margin=0.005):
    """Sites (kind, core, point) in order: the passes one by one."""
    kept, seen = [], {}
    for number, (inner, gap) in enumerate(((True, spacing), (True, 0.0), (False, 0.0)), 1):
        for n, (kind, core, p) in enumerate(sites, 1):
            if len(kept) >= count or n in seen or core != inner:
                continue
            floor = lambda k: running.CONTACTS.get((kind, k)) or running.CONTACTS.get((k, kind)) or running.OTHER  # noqa: B023, E731
            if all((d := math.dist(p, q)) >= floor(k) + margin and d >= gap for k, q in kept):
                kept.append((kind, p))
                seen[n] = number
    return seen


def test_budgets_equal_the_passes_one_by_one(spark):
    rng = random.Random(5)
    data = [("abc"[i % 3], i, rng.choice(["HOH", "MG", "K", "CL"]), rng.random() < 0.6, *(rng.random() * 14 for _ in range(3))) for i in range(360)]
    df = spark.createDataFrame(data, "g string, id long, kind string, core boolean, x double, y double, z double").repartition(3)
    for count in (8, 25, 400):
        found = running.budget(df, ["g"], [F.asc("id")], "kind", F.col("core"), count, 4.0).collect()
        for g in "abc":
            want = plain_budget([(r[2], r[3], r[4:]) for r in data if r[0] == g], count, 4.0)
            assert {r.site: r["pass"] for r in found if r.g == g} == want
            assert len(want) == count or count > 25
    assert any(r["pass"] == 3 for r in found) and any(r["pass"] == 2 for r in found)


@pytest.mark.parametrize("first", [3, 1000])
def test_budgets_of_dense_groups_list_no_pairs(spark, monkeypatch, first):
    monkeypatch.setattr(running, "FIRST", first)
    monkeypatch.setattr(running, "neighbours", None)
    rng = random.Random(6)
    data = [("ab"[i % 2], i, rng.choice(["HOH", "MG", "CL"]), rng.random() < 0.5, *(rng.random() * 6 for _ in range(3))) for i in range(400)]
    df = spark.createDataFrame(data, "g string, id long, kind string, core boolean, x double, y double, z double")
    found = running.budget(df, ["g"], [F.asc("id")], "kind", F.col("core"), 6, 4.0).collect()
    for g in "ab":
        assert {r.site: r["pass"] for r in found if r.g == g} == plain_budget([(r[2], r[3], r[4:]) for r in data if r[0] == g], 6, 4.0)


def test_the_registered_budget_equals_the_passes(spark):
    rows = [(r.label, r.donor, r.vec_id, r.kind, [r.x, r.y, r.z]) for r in exchange._solvent(spark, FOLDER).collect()]
    found = registry.QUERIES["solvent_budget"](spark, FOLDER).collect()
    for label in {r[0] for r in rows}:
        mine = sorted(r for r in rows if r[0] == label)
        assert {r.site: r["pass"] for r in found if r.label == label} == plain_budget([(r[3], r[2] % 3 > 0, r[4]) for r in mine], 9, 4.0)


@pytest.mark.parametrize("shape", ["space", "plane", "line", "mirrored", "point"])
def test_frames_move_points_onto_their_copies(spark, shape):
    rng = np.random.default_rng(3)
    p = rng.normal(size=(15, 3)) * {"space": [1, 2, 3], "mirrored": [1, 2, 3], "plane": [1, 2, 0], "line": [1, 0, 0], "point": [0, 0, 0]}[shape] + 1000
    turn, _ = np.linalg.qr(rng.normal(size=(3, 3)))
    turn *= np.sign(np.linalg.det(turn)) * (-1 if shape == "mirrored" else 1)
    q = (p - 1000) @ turn.T - 400
    data = [("g", *map(float, [*a, *b])) for a, b in zip(p, q, strict=True)]
    df = spark.createDataFrame([*data, ("g", None, 0.0, 0.0, 0.0, 0.0, 0.0)], "g string, p0 double, p1 double, p2 double, q0 double, q1 double, q2 double")
    frames = superposition.frames(df, ["g"], ["p0", "p1", "p2"], ["q0", "q1", "q2"])
    row = frames.first()
    r = np.array([row[f"r{i}{j}"] for i in range(3) for j in range(3)]).reshape(3, 3)
    assert row.n == 15 and np.linalg.det(r) == pytest.approx(1) and r @ r.T == pytest.approx(np.eye(3), abs=1e-9)
    near = np.array([list(x)[1:4] for x in superposition.moved(df.where("p0 IS NOT NULL"), frames, ["g"], ["p0", "p1", "p2"]).select("g", "p0", "p1", "p2", "q0", "q1", "q2").collect()])
    far = np.array([list(x)[4:7] for x in superposition.moved(df.where("p0 IS NOT NULL"), frames, ["g"], ["p0", "p1", "p2"]).select("g", "p0", "p1", "p2", "q0", "q1", "q2").collect()])
    rmsd = math.sqrt(((near - far) ** 2).sum(1).mean())
    want = superposition.superposed_rmsd(df, ["g"], ["p0", "p1", "p2"], ["q0", "q1", "q2"]).first().rmsd
    assert rmsd == pytest.approx(want, abs=1e-5)
    assert rmsd < 1e-6 or shape == "mirrored"


def test_canonical_names(spark):
    staged = ["cofold_af3", "cofold_af3_0", "vina", "a_b", "a_b"]
    names = {
        "cofold_af3_0_0": "cofold_af3_0_0", "cofold_af3_0": "cofold_af3_0", "cofold_af3_7_1": "cofold_af3_7", "cofold_af3_x_1": "cofold_af3_0",
        "vina": "vina", "vina_3": "vina_3", "vinas_3": "vinas_3", "a_b_c_4": "a_b_0", "a_4": "a_4", "": "", "_": "_",
    }
    df = spark.createDataFrame([(n,) for n in [*names, "vina_3", None]], "name string")
    found = assembly.canonical_names(df, spark.createDataFrame([(s,) for s in staged], "stem string"), "name", "stem").collect()
    assert len(found) == len(names) + 2
    assert {r.name: r.canonical for r in found if r.name is not None} == names


def plain_assembly(x, y):
    """x and y: chains as dicts of residue to point; the least fit over all permutations."""
    if len(x) != len(y):
        return None
    best = None
    for order in permutations(range(len(y))):
        shared = [(x[i][k], y[j][k]) for i, j in enumerate(order) for k in set(x[i]) & set(y[j])]
        if not shared:
            continue
        a, b = (np.array(side) - np.mean(side, axis=0) for side in zip(*shared, strict=True))
        u, _, vt = np.linalg.svd(a.T @ b)
        turn = u @ np.diag([1, 1, np.sign(np.linalg.det(u @ vt))]) @ vt
        rmsd = math.sqrt(((a @ turn - b) ** 2).sum() / len(a))
        best = rmsd if best is None else min(best, rmsd)
    return best


def test_assemblies_equal_all_permutations(spark, monkeypatch):
    monkeypatch.setattr(superposition, "ASSIGNED", 100)
    rng = np.random.default_rng(8)
    sides, want = ([], []), {}
    for g, n in enumerate([1, 2, 3, 6, 3]):
        base = [{int(k): rng.normal(size=3) * [3, 2, 1] + 500 for k in rng.choice(9, 6, replace=False)} for _ in range(n)]
        turn, _ = np.linalg.qr(rng.normal(size=(3, 3)))
        turn *= np.sign(np.linalg.det(turn))
        other = [{k: turn @ v + rng.normal(size=3) * 0.2 + 40 for k, v in c.items() if k != 2} for c in base]
        other = [other[i] for i in rng.permutation(n)]
        if g == 4:
            other = other[:2]
        want[g] = plain_assembly(base, other)
        for side, chains in zip(sides, (base, other), strict=True):
            side += [(g, f"c{i}", k, *map(float, v)) for i, c in enumerate(chains) for k, v in c.items()]
    sides[0].append((7, "a", 1, 0.0, 0.0, 0.0))
    sides[1].append((7, "a", 2, 0.0, 0.0, 0.0))
    a, b = (spark.createDataFrame(s, "g long, chain string, residue long, x double, y double, z double") for s in sides)
    found = {r.g: r.rmsd for r in superposition.assemblies(a, b, ["g"], "chain", "residue").collect()}
    assert found.pop(7) is None and found.pop(4) is None and want.pop(4) is None
    assert found == pytest.approx(want, abs=1e-6)


def test_the_registered_assemblies_equal_all_permutations(spark):
    chains = {}
    for r in exchange._chains(spark, FOLDER).collect():
        chains.setdefault(r.label, {}).setdefault(r.chain, {})[r.residue] = [r.x, r.y, r.z]
    found = {r.label: r.rmsd for r in registry.QUERIES["assembly_distances"](spark, FOLDER).collect()}
    want = {g: plain_assembly([chains[g][c] for c in sorted(chains[g])], [chains[g + 1][c] for c in sorted(chains[g + 1])]) for g in chains if g + 1 in chains}
    assert found == pytest.approx(want, abs=2e-6) and len(want) == 9


def test_offsets_equal_the_column_that_slides(spark):
    pairs = [(i, a, b) for i, (a, b) in enumerate([("ABCD", "XXABCD"), ("ABAB", "BABA"), ("", "A"), ("A", ""), ("AB", "CD"), (None, "A"), ("CDEF", "ABCDE"), ("äbä", "xäbä"), ("A" * 30, "A" * 40)])]
    df = spark.createDataFrame(pairs, "id long, a string, b string")
    for least in (1, 3):
        slid = {r.id: (r.o.offset, r.o.matches) for r in df.select("id", superposition.best_offset(F.col("a"), F.col("b"), least).alias("o")).collect()}
        assert {r.id: (r.offset, r.matches) for r in superposition.offsets(df, ["id"], "a", "b", least).collect()} == slid


@pytest.mark.parametrize("long", [0, 5, 1024])
def test_offsets_and_pairs_of_short_strings_take_no_rows_of_letters(spark, monkeypatch, long):
    monkeypatch.setattr(superposition, "LONG", long)
    rng = random.Random(2)
    data = [(i, "".join(rng.choices("ABÄ😀", k=rng.randrange(9))), "".join(rng.choices("ABÄ😀", k=rng.randrange(9)))) for i in range(200)] + [(900, None, "A"), (901, "A\0", "\0A\0\0")]
    df = spark.createDataFrame(data, "id long, a string, b string")
    found = superposition.offsets(df, ["id"], "a", "b")
    shifts = {r.id: (r.offset, r.matches) for r in found.collect()}
    for i, a, b in data:
        counts = {o: sum(0 <= k + o < len(b) and a[k] == b[k + o] for k in range(len(a))) for o in range(1 - len(a), len(b))} if a else {}
        most = max(counts.values(), default=0)
        assert shifts[i] == ((min(o for o in counts if counts[o] == most) if most else 0), most)
    rows = df.join(found, "id")
    pairs = superposition.matched_pairs(rows.select("id", F.col("a").alias("s"), "offset"), rows.select("id", F.col("b").alias("s")), ["id"], "s", F.col("offset"))
    want = {(i, k, k + shifts[i][0], a[k]) for i, a, b in data for k in range(len(a or "")) if 0 <= k + shifts[i][0] < len(b) and a[k] == b[k + shifts[i][0]]}
    assert sorted(map(tuple, pairs.collect())) == sorted(want)
    if long == 1024:
        assert "MapInArrow" in found._jdf.queryExecution().toString()
        assert "inline" in pairs._jdf.queryExecution().toString()
