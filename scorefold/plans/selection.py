"""Queries that rank, cluster and select poses; embeddings are poses of ten targets, their first three numbers coordinates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors
from ..operators import contacts, poses, ranking, spatial
from ..sources.tables import table
from .catalogue import _POINTS, KEY, RADIUS, _points
from .registry import query

# score: NULL for some; dev: NULL for most of them
_SCORED = f"""{_POINTS}, sc AS (SELECT *, CASE WHEN vec_id % 11 <> 0 THEN (vec_id * 37 % 101) / 100.0 END AS score, CASE WHEN vec_id % 3 = 0 THEN vec_id * 13 % 17 END AS dev FROM e),
strict AS (SELECT * FROM d WHERE distance < 0.06), both_ways AS (SELECT a, b FROM strict UNION ALL SELECT b, a FROM strict),
reach(a, b) AS (SELECT vec_id, vec_id FROM e UNION SELECT r.a, w.b FROM reach r JOIN both_ways w ON r.b = w.a),
c AS (SELECT a AS vec_id, min(b) AS cluster FROM reach GROUP BY a), k AS (SELECT * FROM sc JOIN c USING (vec_id)),
q AS (SELECT label, cluster, min(vec_id) AS first, count(*) AS size, count(DISTINCT family) AS families, coalesce(max(score), 0) AS best, coalesce(sum(score), 0) AS total FROM k GROUP BY label, cluster)"""


def _scored(spark: SparkSession, d: str) -> DataFrame:
    score = F.when(F.col("vec_id") % 11 != 0, F.col("vec_id") * 37 % 101 / 100.0)
    return _points(spark, d).withColumns({"score": score, "dev": F.when(F.col("vec_id") % 3 == 0, F.col("vec_id") * 13 % 17)})


@query(
    f"""WITH RECURSIVE {_SCORED} SELECT label, cluster, first, size, families, best, round(total, 6) AS total, round(best * ln(1 + families), 6) AS by_families,
round(best * ln(1 + size), 6) AS by_size_log, round(size * best, 6) AS by_size FROM q"""
)
def cluster_quality(spark: SparkSession, d: str) -> DataFrame:
    clustered = spatial.single_link(_scored(spark, d), ["label"], "vec_id", RADIUS, strict=True)
    return poses.cluster_qualities(clustered, ["label"], "family", "score", "vec_id")


@query(
    f"""WITH RECURSIVE {_SCORED}, t AS (SELECT * FROM (SELECT *, round(best * ln(1 + families), 6) AS by_families, row_number() OVER (PARTITION BY label ORDER BY round(best * ln(1 + families), 6) DESC, first) AS rank FROM q) WHERE rank <= 3),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY label, cluster ORDER BY dev NULLS LAST, score DESC NULLS LAST, vec_id) AS pl FROM k) WHERE pl = 1)
SELECT t.label, t.cluster, rank, by_families, vec_id FROM t JOIN p ON t.label = p.label AND t.cluster = p.cluster"""
)
def top_clusters(spark: SparkSession, d: str) -> DataFrame:
    clustered = spatial.single_link(_scored(spark, d), ["label"], "vec_id", RADIUS, strict=True)
    return poses.top_clusters(clustered, ["label"], "family", "score", "dev", "vec_id", 3)


@query(
    f"""WITH {_POINTS}, sc AS (SELECT *, CASE WHEN vec_id % 11 <> 0 THEN (vec_id * 37 % 101) / 100.0 END AS score, nullif(weight, 1) AS w FROM e),
s AS (SELECT a AS v FROM d WHERE distance < 0.06 AND fa <> fb UNION ALL SELECT b FROM d WHERE distance < 0.06 AND fa <> fb), n2 AS (SELECT v, count(*) AS support FROM s GROUP BY v),
r AS (SELECT *, CASE WHEN score IS NULL THEN 0 ELSE 1.0 / (60 + row_number() OVER (PARTITION BY label, score IS NULL ORDER BY score DESC, vec_id)) END
 + CASE WHEN w IS NULL THEN 0 ELSE 1.0 / (60 + row_number() OVER (PARTITION BY label, w IS NULL ORDER BY w DESC, vec_id)) END AS rrf FROM sc),
f AS (SELECT label, vec_id, round(rrf * (1 + 0.1 * ln(1 + coalesce(support, 0))) + CASE WHEN family = 3 THEN 0.2 * coalesce(score, 0) ELSE 0 END, 9) AS final FROM r LEFT JOIN n2 ON v = vec_id)
SELECT label, vec_id, final FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY final DESC, vec_id) AS pl FROM f) WHERE pl <= 5"""
)
def final_ranking(spark: SparkSession, d: str) -> DataFrame:
    rows = _scored(spark, d).withColumn("w", F.nullif(F.col("weight"), F.lit(1.0)))
    fused = ranking.reciprocal_ranks(rows, ["label"], ["score", "w"], ["vec_id"])
    supported = fused.join(spatial.support(rows, ["label"], "vec_id", "family", RADIUS).select("vec_id", "support"), "vec_id")
    found = poses.final_scores(supported, "rrf", "support", "score", F.col("family") == 3)
    return found.withColumn("_at", ranking.place(["label"], F.desc("final"), F.asc("vec_id"))).where("_at <= 5").select("label", "vec_id", "final")


_PAIR = "p AS (SELECT a.vec_id, a.embedding AS a, CASE WHEN b.vec_id % 7 = 0 THEN b.embedding[1:60] ELSE b.embedding END AS b FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)"


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings")
    after = rows.select((F.col("vec_id") - 1).alias("vec_id"), F.when(F.col("vec_id") % 7 == 0, F.slice("embedding", 1, 60)).otherwise(F.col("embedding")).alias("b"))
    return rows.select("vec_id", F.col("embedding").alias("a")).join(after, "vec_id")


@query(f"WITH {_PAIR} SELECT vec_id, CASE WHEN len(a) = len(b) THEN round(sqrt(list_sum(list_transform(range(1, len(a) + 1), lambda i: (a[i]::DOUBLE - b[i]::DOUBLE) * (a[i]::DOUBLE - b[i]::DOUBLE))) / len(a)), 6) END AS rmsd FROM p")
def index_rmsd(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).select("vec_id", F.round(vectors.index_rmsd(F.col("a"), F.col("b")), 6).alias("rmsd"))


@query(
    f"""WITH {_PAIR}, o AS (SELECT vec_id, list_filter(range(1, len(a) + 1), lambda i: a[i] > 0.1) AS x, list_filter(range(1, len(b) + 1), lambda i: b[i] > 0.1) AS y FROM p)
SELECT vec_id, round(coalesce(len(list_intersect(x, y)) / nullif(len(list_distinct(list_concat(x, y))), 0), 0), 6) AS tanimoto FROM o"""
)
def tanimoto(spark: SparkSession, d: str) -> DataFrame:
    on = lambda c: F.filter(F.transform(c, lambda x, i: F.when(x > 0.1, i)), lambda i: i.isNotNull())
    return _pairs(spark, d).select("vec_id", F.round(vectors.tanimoto(on(F.col("a")), on(F.col("b"))), 6).alias("tanimoto"))


@query(f"WITH {_POINTS} SELECT vec_id, round(0.6 * x - 0.8 * y + 1, 6) AS u, round(0.8 * x + 0.6 * y - 2, 6) AS v, round(z + 0.5, 6) AS w FROM e")
def moved_points(spark: SparkSession, d: str) -> DataFrame:
    moved = vectors.transformed(F.col("x"), F.col("y"), F.col("z"), [[0.6, -0.8, 0.0], [0.8, 0.6, 0.0], [0.0, 0.0, 1.0]], [1.0, -2.0, 0.5])
    return _points(spark, d).select("vec_id", *[F.round(m, 6).alias(n) for m, n in zip(moved, "uvw", strict=True)])


@query(
    f"""WITH {_POINTS} SELECT label, round((min(x) + max(x)) / 2, 6) AS centre_x, round((min(y) + max(y)) / 2, 6) AS centre_y, round((min(z) + max(z)) / 2, 6) AS centre_z,
round(greatest(22.5, least(40.0, greatest((max(x) - min(x)) * 30, (max(y) - min(y)) * 30, (max(z) - min(z)) * 30) + 8)), 6) AS side FROM e GROUP BY label"""
)
def boxes(spark: SparkSession, d: str) -> DataFrame:
    return poses.boxes(_points(spark, d), ["label"], 30.0)


@query(
    f"""WITH {_POINTS}, c AS (SELECT label, avg(x) AS cx, avg(y) AS cy, avg(z) AS cz FROM e GROUP BY label),
f AS (SELECT label, round(sqrt((x - cx) ** 2 + (y - cy) ** 2 + (z - cz) ** 2), 9) AS far FROM e JOIN c USING (label)), g AS (SELECT *, avg(far) OVER (PARTITION BY label) AS mean FROM f)
SELECT label, count(*) AS n, round(max(far), 6) AS radius, count(*) FILTER (far >= 1.5 * mean) AS outliers FROM g GROUP BY label"""
)
def extent_audit(spark: SparkSession, d: str) -> DataFrame:
    return poses.extents(_points(spark, d), ["label"], 1.5)


@query(
    f"""WITH {_POINTS}, t AS (SELECT label, family, max(weight) AS weight, count(*) AS n, round(avg(x), 6) AS x, round(avg(y), 6) AS y, round(avg(z), 6) AS z FROM e GROUP BY label, family)
SELECT label, family, weight, n, x, y, z FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY weight DESC, family) AS pl FROM t) WHERE pl = 1"""
)
def template_anchors(spark: SparkSession, d: str) -> DataFrame:
    return poses.template_anchors(_points(spark, d), ["label"], "family", "weight")


_A, _B = "nullif(l_discount, 0.1)", "nullif(l_tax, 0.08)"
_O = "l_orderkey, l_linenumber, l_quantity"


def _strategy(name: str, order: str) -> str:
    return f"""SELECT '{name}' AS strategy, count(*) AS n, count(*) FILTER (l_quantity < 5) AS hits, round(avg(l_quantity), 6) AS mean_truth
FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY {order}, {_O}) AS pl FROM lineitem) WHERE pl = 1"""


@query(
    " UNION ALL ".join(
        [
            _strategy("score", f"{_A} DESC NULLS LAST"),
            _strategy("deviation", f"{_B} NULLS LAST, {_A} DESC NULLS LAST"),
            _strategy("cofold_only", f"l_returnflag <> 'R', {_A} DESC NULLS LAST"),
            _strategy("gated", f"l_quantity < 25, {_A} DESC NULLS LAST, {_B} DESC NULLS LAST"),
        ]
    )
)
def selection_strategies(spark: SparkSession, d: str) -> DataFrame:
    """Rows outside a strategy's pool come last, so a target without any falls back to all its rows."""
    items = table(spark, d, "lineitem").selectExpr("*", "nullif(l_discount, 0.1D) AS a", "nullif(l_tax, 0.08D) AS b")
    best = F.desc_nulls_last("a")
    choices = {
        "score": [best], "deviation": [F.asc_nulls_last("b"), best], "cofold_only": [(F.col("l_returnflag") != "R").asc(), best],
        "gated": [(F.col("l_quantity") < 25).asc(), best, F.desc_nulls_last("b")],
    }
    return poses.strategies(items, "l_partkey", choices, "l_quantity", [*KEY, "l_quantity"], 5.0)


@query(
    f"""SELECT l_partkey, ligand, rank, l_quantity FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey, ligand ORDER BY l_discount DESC, {_O}) AS rank
FROM (SELECT *, coalesce(nullif(l_returnflag, 'N'), 'A') AS ligand FROM lineitem)) WHERE rank <= 2"""
)
def per_ligand_selection(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "lineitem").withColumn("ligand", F.nullif(F.col("l_returnflag"), F.lit("N")))
    found = poses.per_ligand(items, "l_partkey", "ligand", F.lit("A"), [F.desc("l_discount"), *map(F.asc, [*KEY, "l_quantity"])], 2)
    return found.select("l_partkey", "ligand", "rank", "l_quantity")


@query(
    """WITH s AS (SELECT p_brand, p_type, sum(p_size) AS evidence, count(*) AS entries FROM part GROUP BY p_brand, p_type),
w AS (SELECT *, evidence / sum(evidence) OVER (PARTITION BY p_brand) AS share, row_number() OVER (PARTITION BY p_brand ORDER BY evidence DESC, p_type) AS pl FROM s),
g AS (SELECT *, share >= 0.2 AND entries >= 2 AS good FROM w), h AS (SELECT *, bool_or(good) OVER (PARTITION BY p_brand) AS any_good FROM g),
m AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY evidence DESC, p_type) AS rank FROM h WHERE good OR (NOT any_good AND pl = 1 AND share >= 0.3 AND entries >= 3))
SELECT p_brand, p_type, evidence, entries, rank, round(1 + share, 3) AS weight FROM m WHERE rank <= 2"""
)
def site_shares(spark: SparkSession, d: str) -> DataFrame:
    sites = table(spark, d, "part").groupBy("p_brand", "p_type").agg(F.sum("p_size").alias("evidence"), F.count(F.lit(1)).alias("entries"))
    return poses.sites_by_share(sites, "p_brand", "evidence", "entries", "p_type")


@query(
    f"""WITH {_POINTS}, s AS (SELECT *, vec_id * 37 % 101 AS score, round((x - 0.1) ** 2 + (y - 0.1) ** 2, 12) AS far FROM e),
r AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY score DESC, vec_id) AS rank, row_number() OVER (PARTITION BY family ORDER BY far, vec_id) AS near FROM s)
SELECT family, vec_id, rank, near = 1 AS nearest FROM r WHERE rank <= 3 OR near = 1"""
)
def surfaced_poses(spark: SparkSession, d: str) -> DataFrame:
    far = F.round(F.pow(F.col("x") - 0.1, F.lit(2)) + F.pow(F.col("y") - 0.1, F.lit(2)), 12)
    rows = _points(spark, d).withColumns({"score": F.col("vec_id") * 37 % 101, "far": far})
    return poses.surfaced(rows, "family", [F.desc("score")], F.col("far"), "vec_id", 3).select("family", "vec_id", "rank", "nearest")


@query(
    """WITH r AS (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS rank, p_size FROM part),
f AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_size > 40 DESC, p_size DESC, rank) = 1 AND p_size > 40 AS front FROM r)
SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY front DESC, rank) AS new_rank FROM f"""
)
def moved_to_front(spark: SparkSession, d: str) -> DataFrame:
    ranked = table(spark, d, "part").withColumn("rank", ranking.place(["p_brand"], F.desc("p_retailprice"), F.asc("p_partkey")))
    return poses.moved_to_front(ranked, "p_brand", "rank", F.col("p_size") > 40, "p_size").select("p_brand", "p_partkey", "new_rank")


@query(
    f"""SELECT l_partkey, l_returnflag, l_discount FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY CASE l_returnflag WHEN 'R' THEN 1 ELSE 2 END, l_discount DESC, {_O}) AS pl
FROM lineitem WHERE l_returnflag IN ('R', 'A')) WHERE pl = 1"""
)
def box_priority(spark: SparkSession, d: str) -> DataFrame:
    found = poses.by_priority(table(spark, d, "lineitem"), "l_partkey", "l_returnflag", ["R", "A"], [F.desc("l_discount"), *map(F.asc, [*KEY, "l_quantity"])])
    return found.select("l_partkey", "l_returnflag", "l_discount")


@query("SELECT o_custkey, o_orderkey AS best, o_totalprice AS price FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS pl FROM orders) WHERE pl = 1")
def best_models(spark: SparkSession, d: str) -> DataFrame:
    best = F.max_by("o_orderkey", F.struct("o_totalprice", -F.col("o_orderkey")))
    return table(spark, d, "orders").groupBy("o_custkey").agg(best.alias("best"), F.max("o_totalprice").alias("price"))


@query(
    """WITH e AS (SELECT vec_id, label, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings)
SELECT a.label, a.vec_id, round(sqrt(min((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2)), 6) AS distance FROM e a JOIN e b ON a.label = b.label AND a.vec_id % 2 = 1 AND b.vec_id % 10 = 0 GROUP BY a.label, a.vec_id"""
)
def nearest_instance(spark: SparkSession, d: str) -> DataFrame:
    rows = _points(spark, d)
    found = contacts.nearest(rows.where("vec_id % 2 = 1"), rows.where("vec_id % 10 = 0"), ["label"], "vec_id", RADIUS)
    return found.select("label", F.col("a").alias("vec_id"), F.round("distance", 6).alias("distance"))
