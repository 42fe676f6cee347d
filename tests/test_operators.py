import math
import random

import pytest
from pyspark.sql import functions as F

from scorefold.functions import parsing
from scorefold.operators import forest, lineage, ranking, screening, spatial
from scorefold.sources.tables import predictions, search_hits


def test_diverse_selection_equals_a_plain_loop(spark):
    data = [(g, i, float(i * 7 % 11), [float(i % 5), float(i % 3)]) for g in ("a", "b") for i in range(30)]
    df = spark.createDataFrame(data, "g string, id long, score double, point array<double>")
    found = {(r.g, r.id) for r in ranking.diverse_top_k(df, ["g"], "score", "point", "id", k=4, distance=2.0).collect()}
    want = set()
    for g in ("a", "b"):
        chosen = []
        for _, i, _, p in sorted((r for r in data if r[0] == g), key=lambda r: (-r[2], r[1])):
            if len(chosen) < 4 and all(math.dist(p, q) >= 2 for _, q in chosen):
                chosen.append((i, p))
        want |= {(g, i) for i, _ in chosen}
    assert found == want


def test_diverse_selection_goes_on_past_many_close_rows(spark):
    data = [("a", i, 5000.0 - i, [0.0, i % 10 / 10]) for i in range(3000)] + [("a", 3000 + i, float(-i), [4.0 * (i + 1), 0.0]) for i in range(9)]
    data += [(None, 1, 2.0, None), (None, 2, 1.0, [None, 0.0]), (None, 3, 1.0, [0.0, 0.0]), (None, 4, float("nan"), [1.0, 0.0]), (None, 5, None, [9.0, 9.0])]
    df = spark.createDataFrame(data, "g string, id long, score double, point array<double>")
    found = ranking.diverse_top_k(df, ["g"], "score", "point", "id", k=4, distance=2.0)
    want = {("a", 0, 1), ("a", 3000, 2), ("a", 3001, 3), ("a", 3002, 4), (None, 4, 1)}
    assert {(r.g, r.id, r.rank) for r in found.collect()} == want
    assert found.dtypes == [("g", "string"), ("id", "bigint"), ("score", "double"), ("rank", "int")]
    unreadable = df.where("g is null and not isnan(score)")
    assert [(r.id, r.rank) for r in ranking.diverse_top_k(unreadable, ["g"], "score", "point", "id").collect()] == [(1, 1), (3, 2)]


def test_tied_scores_have_average_ranks_and_the_hand_computed_auc(spark):
    df = spark.createDataFrame([(1, 4.0, 1), (2, 3.0, 0), (3, 3.0, 1), (4, 1.0, 0)], "id long, score double, hit int")
    ranked = ranking.average_ranks(df.withColumn("g", F.lit(1)), ["g"], "score", "r").orderBy("id")
    assert [r.r for r in ranked.collect()] == [1, 2.5, 2.5, 4]
    assert screening.metrics(df, "score", "hit", ["id"]).first().auc == 0.875
    assert screening.metrics(df.where("hit = 1"), "score", "hit", ["id"]).first().auc is None
    assert screening.metrics(df.where("hit > 1"), "score", "hit", ["id"]).first().n_rows == 0


def test_rank_sums_are_dealt_by_rows(spark, monkeypatch):
    monkeypatch.setattr(lineage, "ROWS", 10)
    df = spark.createDataFrame([(i % 50, i, float(i * 7 % 5), float(i * 3 % 4)) for i in range(300)], "g long, id long, a double, b double")
    found = ranking.rank_sum_best(df, ["g"], ["a", "b"], ["id"])
    assert found.rdd.getNumPartitions() == 30
    rows, want = df.collect(), {}
    for r in rows:
        mine = [x for x in rows if x.g == r.g]
        rank = lambda c, r=r, mine=mine: 1 + sum(x[c] > r[c] for x in mine) + (sum(x[c] == r[c] for x in mine) - 1) / 2
        want[r.g] = min(want.get(r.g, (99, 0)), (rank("a") + rank("b"), r.id))
    assert {r.g: (r.rank_sum, r.id) for r in found.collect()} == want


def test_clusters_follow_chains_and_name_their_smallest_key(spark):
    df = spark.createDataFrame([("t", i, i * 0.9, 0.0, 0.0) for i in range(12)] + [("t", 99, 50.0, 0.0, 0.0)], "g string, id long, x double, y double, z double")
    found = {r.id: r.cluster for r in spatial.single_link(df, ["g"], "id", 1.0).collect()}
    assert {found[i] for i in range(12)} == {0} and found[99] == 99


def plain_clusters(data, radius, strict):
    """Cluster of each (g, id): links of all pairs, one by one."""
    label = {r[:2]: r[1] for r in data}
    for i, p in enumerate(data):
        for q in data[:i]:
            if p[0] == q[0] and p[0] is not None and None not in (*p[2:], *q[2:]) and label[p[:2]] != label[q[:2]]:
                d = sum((a - b) * (a - b) for a, b in zip(p[2:], q[2:], strict=True)) ** 0.5
                if d < radius or (d == radius and not strict):
                    low, high = sorted((label[p[:2]], label[q[:2]]))
                    label = {k: low if v == high and k[0] == p[0] else v for k, v in label.items()}
    return label


@pytest.mark.parametrize("strict", [False, True])
@pytest.mark.parametrize("pairs", [0, 20, 1024])
def test_clusters_of_boxes_equal_a_plain_walk(spark, monkeypatch, pairs, strict):
    monkeypatch.setattr(spatial, "PAIRS", pairs)
    rng = random.Random(11)
    ball = lambda x, n, wide: [(x + rng.random() * wide, rng.random() * wide, rng.random() * wide) for _ in range(n)]
    places = {
        "a": ball(0.0, 40, 0.3) + ball(1.2, 40, 0.3) + ball(2.6, 40, 0.3) + ball(3.9, 3, 0.05),  # gaps just under and over 1
        "b": [(i * 0.5, j * 0.5, 0.0) for i in range(-5, 6) for j in range(3) if i % 4] + [(5.5, 0.0, 0.0)] * 5 + [(6.5, 0.0, 0.0)] * 5,
        "c": ball(-4.0, 90, 6.0),
        "d": [(float("nan"), 0.0, 0.0)] * 2 + [(float("inf"), 0.0, 0.0)] * 2 + [(None, 0.0, 0.0)] * 2 + [(1e20, 0.0, 0.0)] * 2 + [(3e20, 0.0, 0.0), (-0.0, 0.0, 0.0), (0.0, -1.0, 0.0)],
        None: [(0.0, 0.0, 0.0)] * 2,
    }
    data = [(g, i, *p) for g, rows in places.items() for i, p in enumerate(rng.sample(rows, len(rows)))]
    df = spark.createDataFrame(data, "g string, id long, x double, y double, z double")
    found = spatial.single_link(df, ["g"], "id", 1.0, strict).collect()
    assert len(found) == len(data)
    assert {(r.g, r.id): r.cluster for r in found} == plain_clusters(data, 1.0, strict)


def test_dense_points_are_not_paired(spark, monkeypatch):
    listed, neighbours = [], spatial.neighbours
    monkeypatch.setattr(spatial, "neighbours", lambda *given: listed.append(neighbours(*given).count()) or neighbours(*given))
    near = F.array(*[F.rand(s) * 0.2 + F.when(F.col("id") % 2 == 0, 1.1).otherwise(0.0) * int(s == 1) for s in (1, 2, 3)])
    df = spark.range(6000).select(F.lit("t").alias("g"), "id", near.alias("p")).select("g", "id", *[F.col("p")[i].alias(a) for i, a in enumerate("xyz")])
    assert {r.cluster for r in spatial.single_link(df, ["g"], "id", 1.0).collect()} == {0}
    assert sum(listed) <= 216 * 64
    listed.clear()
    assert forest.single_link_cutoffs(df, ["g"], "id", [0.05, 1.0]).where("cutoff = 1 AND cluster = 0").count() == 6000
    assert sum(listed) <= 216 * 64 + 216 * 6000 / 2


def test_cutoffs_of_zero_join_copies(spark):
    inf, nan = float("inf"), float("nan")
    data = [("a", i, *p) for i, p in enumerate([(0.0, 1.0, 2.0), (-0.0, 1.0, 2.0), (0.5, 1.0, 2.0), (inf, 0.0, 0.0), (inf, 0.0, 0.0), (nan, 0.0, 0.0), (nan, 0.0, 0.0), (1e300, 0.0, 0.0), (1e300, 0.0, 0.0)])]
    df = spark.createDataFrame(data, "g string, id long, x double, y double, z double")
    found = {(r.cutoff, r.id): r.cluster for r in forest.single_link_cutoffs(df, ["g"], "id", [0.5, -1.0, 0.0]).collect()}
    want = {-1.0: range(9), 0.0: [0, 0, 2, 3, 4, 5, 6, 7, 7], 0.5: [0, 0, 0, 3, 4, 5, 6, 7, 7]}
    assert found == {(c, i): cluster for c, clusters in want.items() for i, cluster in enumerate(clusters)}


def test_missing_text_and_scores(spark):
    df = spark.createDataFrame([("", 0.2), ("None", 1.7), ("NaN", None), ("2.5", -1.0), ("x", 0.95)], "t string, p double")
    got = df.select(parsing.number(F.col("t")).alias("n"), F.round(parsing.closeness(F.col("p")), 6).alias("c")).collect()
    assert [r.n for r in got] == [None, None, None, 2.5, None]
    assert [r.c for r in got] == [0.8, 0.0, None, 1.0, 0.05]


def test_scans_skip_short_rows(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("\t".join(map(str, range(14))) + "\nshort\n" + "\t".join(map(str, range(12))) + "\n")
    (tmp_path / "b.tsv").write_text("q\tt\t1e-5\t9\t.5\t.6\t.7\t1\nq\tt\n")
    (tmp_path / "score_x.tsv").write_text("Name\tpKd\nn1\t7.5\n\t3\nn2\tbad\n")
    hits = search_hits(spark, str(tmp_path / "a.tsv"), str(tmp_path / "b.tsv"))
    assert {r["source"]: r["count"] for r in hits.groupBy("source").count().collect()} == {"sequence": 2, "structure": 1}
    assert [tuple(r) for r in predictions(spark, str(tmp_path / "score_*.tsv"), "score_", ["pKd"]).collect()] == [("x", "n1", 7.5)]
