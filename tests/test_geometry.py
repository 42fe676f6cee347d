import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from scorefold.operators import contacts, greedy, screening, superposition


def test_seeds_equal_a_walk(spark):
    rng = random.Random(3)
    data = [(g, i, rng.random() * 3, rng.random() * 3, rng.choice([0.0, 1.0]), float(i % 4)) for i, g in enumerate("aab" * 60)]
    df = spark.createDataFrame(data, "g string, id long, x double, y double, z double, score double")
    found = {r.id: r.seed for r in greedy.seeds(df, ["g"], "id", [-F.col("score")], 0.7).collect()}
    want = {}
    for g in "ab":
        kept = []
        for _, i, *p, _ in sorted((r for r in data if r[0] == g), key=lambda r: (-r[5], r[1])):
            near = [k for k, q in kept if math.dist(p, q) < 0.7]
            kept += [] if near else [(i, p)]
            want[i] = near[0] if near else i
    assert found == want
    assert greedy.seeds(df.where("id < 0"), ["g"], "id", [], 0.7).collect() == []
    alone = greedy.seeds(df.where("id = 5"), ["g"], "id", [], 0.7).collect()
    assert [(r.id, r.seed) for r in alone] == [(5, 5)]


@pytest.mark.parametrize("mirrored", [False, True])
def test_superposed_rmsd_equals_the_singular_value_fit(spark, mirrored):
    rng = np.random.default_rng(5)
    data, want = [], {}
    for g in range(6):
        p = rng.normal(size=(12, 3)) * [1, 2, 0 if g == 1 else 3]
        turn, _ = np.linalg.qr(rng.normal(size=(3, 3)))
        turn *= np.sign(np.linalg.det(turn)) * (-1 if mirrored else 1)
        q = p @ turn + 5 + (rng.normal(size=p.shape) * 0.3 if g else 0)
        a, b = p - p.mean(0), q - q.mean(0)
        u, s, vt = np.linalg.svd(a.T @ b)
        s[2] *= np.sign(np.linalg.det(u @ vt))
        want[g] = math.sqrt(max(((a**2).sum() + (b**2).sum() - 2 * s.sum()) / len(p), 0))
        data += [(g, *map(float, [*x, *y])) for x, y in zip(p, q, strict=True)]
    df = spark.createDataFrame(data, "g long, a double, b double, c double, d double, e double, f double")
    found = {r.g: r.rmsd for r in superposition.superposed_rmsd(df, ["g"], ["a", "b", "c"], ["d", "e", "f"]).collect()}
    assert found == pytest.approx(want, abs=2e-6)


def test_best_offset_equals_a_plain_slide(spark):
    pairs = [("ABCD", "XXABCD"), ("ABAB", "BABA"), ("", "A"), ("A", ""), ("AB", "CD"), (None, "A"), ("CDEF", "ABCDE")]
    df = spark.createDataFrame(pairs, "a string, b string").select("a", "b", superposition.best_offset(F.col("a"), F.col("b")).alias("o"))
    for a, b, o in df.collect():
        best = (0, 0)
        for shift in range(1 - len(a or ""), len(b or "")):
            n = sum(0 <= i + shift < len(b) and c == b[i + shift] for i, c in enumerate(a or ""))
            best = (shift, n) if n > best[1] else best
        assert (o.offset, o.matches) == best


def test_random_baseline_equals_a_plain_loop(spark, monkeypatch):
    sizes = spark.createDataFrame([("a", 50, 5), ("b", 7, 0), ("c", 7, 7), ("d", 300, 90)], "g string, n long, k long")
    found = {r.g: r for r in screening.random_bedroc(sizes, "g", "n", "k", draws=300).collect()}
    assert found["b"].mean is None and found["c"].p95 is None
    for g, n, k in (("a", 50, 5), ("d", 300, 90)):
        values = []
        for t in range(300):
            ranks = 1 + np.random.default_rng([0, t]).choice(n, k, replace=False, shuffle=False)
            rie = np.exp(-20 * ranks / n).mean() / np.exp(-20 * np.arange(1, n + 1) / n).mean()
            scale = k / n * math.sinh(10) / (math.cosh(10) - math.cosh(10 - 20 * k / n))
            values.append(rie * scale + 1 / (1 - math.exp(20 * (1 - k / n))))
        assert found[g].mean == pytest.approx(np.mean(values), abs=2e-6)
        assert found[g].p95 == pytest.approx(np.percentile(values, 95), abs=2e-6)
    # drawn in blocks, the sum has the same mean
    monkeypatch.setattr(screening, "RANKS", 16)
    rng = np.random.default_rng(1)
    sums = [screening.drawn_sum(50, 5, 20.0, rng) for _ in range(4000)]
    assert np.mean(sums) == pytest.approx(5 * np.exp(-20 * np.arange(1, 51) / 50).mean(), rel=0.05)


def test_gates_on_empty_sides_and_a_margin_of_zero(spark):
    df = spark.createDataFrame([(1, 1, 0.0, 0.0, 0.0), (1, 2, 1.0, 0.0, 0.0)], "g long, id long, x double, y double, z double")
    none = df.where("false")
    assert contacts.near_surface(df, none, ["g"], "id", 0).count() == 2
    assert contacts.near_surface(df, none, ["g"], "id", 1.0).count() == 0
    assert contacts.without_overlaps(df.withColumn("pose", F.lit(1)), none, ["g"], "pose", "id", 1.0).count() == 2
    hosts = contacts.host_chains(df.withColumn("chain", F.lit("A")), none.withColumn("chain", F.lit("A")), ["g"], "id", "chain", 1.0)
    assert {(r.id, r.host, r.contacts) for r in hosts.collect()} == {(1, "A", 0), (2, "A", 0)}
