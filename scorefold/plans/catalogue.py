"""Registered queries of the ranking engine and the SQL each is held against.

The supplied tables stand in for candidates: a part is a target, its line items are its candidates,
discount (many ties), tax and price are scores, quantity is the truth (smaller is better).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import parsing
from ..operators import evaluation, evidence, ranking, screening, spatial, statistics
from ..sources.tables import table
from .registry import query

NATIVE = 5.0
KEY = ["l_orderkey", "l_linenumber"]


def candidates(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part").select("p_partkey", F.col("p_type").alias("zone"), F.col("p_brand").alias("cluster"))
    items = table(spark, d, "lineitem").select(*KEY, F.col("l_partkey").alias("target"), "l_quantity", "l_discount", "l_tax", "l_extendedprice")
    return items.join(part, F.col("target") == F.col("p_partkey")).drop("p_partkey")


_RANKED = """r AS (SELECT l_partkey AS target, l_quantity AS truth, row_number() OVER (PARTITION BY l_partkey
  ORDER BY l_discount DESC, l_orderkey, l_linenumber) AS pl FROM lineitem),
m AS (SELECT target, any_value(p_type) AS zone, any_value(p_brand) AS cluster, count(*) AS n_rows,
  min(CASE WHEN pl = 1 THEN truth END) < 5 AS top1_native, min(CASE WHEN pl <= 5 THEN truth END) < 5 AS top5_native,
  min(truth) < 5 AS oracle_native FROM r JOIN part ON target = p_partkey GROUP BY target)"""


def _rates(policy: str, source: str) -> str:
    mean = ", ".join(f"round(avg(CAST({m} AS DOUBLE)), 6) AS {m}" for m in evaluation.METRICS)
    return f"SELECT '{policy}' AS policy, CASE WHEN grouping(zone) = 1 THEN 'ALL' ELSE zone END AS zone, count(*) AS n, {mean} FROM {source} GROUP BY GROUPING SETS ((zone), ())"


def _target_outcomes(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.outcomes(candidates(spark, d), ["target", "zone", "cluster"], "l_discount", "l_quantity", KEY, NATIVE)


@query(f"WITH {_RANKED} {_rates('per_target', 'm')}")
def success_rates(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.rates(_target_outcomes(spark, d), "per_target")


@query(
    f"""WITH {_RANKED}, p AS (SELECT *, min(target) OVER (PARTITION BY cluster) AS rep FROM m),
a AS (SELECT arg_min(zone, target) AS zone, {", ".join(f"bool_or({m}) AS {m}" for m in evaluation.METRICS)} FROM m GROUP BY cluster),
v AS (SELECT arg_min(zone, target) AS zone, {", ".join(f"avg(CAST({m} AS DOUBLE)) AS {m}" for m in evaluation.METRICS)} FROM m GROUP BY cluster)
{_rates("per_target", "m")} UNION ALL {_rates("cluster_rep_only", "(SELECT * FROM p WHERE target = rep)")}
UNION ALL {_rates("cluster_any", "a")} UNION ALL {_rates("cluster_mean", "v")}"""
)
def cluster_success_rates(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.cluster_policies(_target_outcomes(spark, d), "target", "cluster")


@query(
    f"""WITH {_RANKED}, f AS (SELECT target, min(CASE WHEN truth < 5 THEN pl END) AS first FROM r GROUP BY target)
SELECT k, count(*) AS n_groups, round(avg(CASE WHEN coalesce(first <= k, false) THEN 1.0 ELSE 0.0 END), 6) AS success
FROM f, (SELECT unnest([1, 2, 3, 5, 10, 20, 50, 100]) AS k) GROUP BY k"""
)
def topk_success_curve(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.topk_curve(candidates(spark, d), ["target"], "l_discount", "l_quantity", KEY, NATIVE, [1, 2, 3, 5, 10, 20, 50, 100])


def _scorer_sql(name: str, order: str) -> str:
    return f"""SELECT '{name}' AS scorer, count(*) AS n, count(*) FILTER (t1 < 5) AS top1_hits, count(*) FILTER (t5 < 5) AS best5_hits,
list_sort(list(t1))[count(*) // 2 + 1] AS median_top1, list_sort(list(t5))[count(*) // 2 + 1] AS median_best5 FROM (
SELECT l_partkey, min(CASE WHEN pl = 1 THEN l_quantity END) AS t1, min(CASE WHEN pl <= 5 THEN l_quantity END) AS t5 FROM (
SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY {name} {order}, l_orderkey, l_linenumber) AS pl FROM lineitem) GROUP BY l_partkey)"""


@query(" UNION ALL ".join([_scorer_sql("l_discount", "DESC"), _scorer_sql("l_tax", "ASC"), _scorer_sql("l_extendedprice", "DESC")]))
def scorer_comparison(spark: SparkSession, d: str) -> DataFrame:
    scorers = {"l_discount": False, "l_tax": True, "l_extendedprice": False}
    return evaluation.scorer_table(candidates(spark, d), ["target"], scorers, "l_quantity", KEY, NATIVE)


_MERGED = """u AS (
SELECT 0 AS l, l_partkey, l_suppkey, l_orderkey * 10 + l_linenumber AS o, l_tax AS evalue, l_discount AS pident, NULL AS quality, l_shipmode FROM
 (SELECT *, l_linestatus AS l_shipmode FROM lineitem) WHERE l_returnflag = 'R'
UNION ALL SELECT 1, l_partkey, l_suppkey, l_orderkey * 10 + l_linenumber, l_tax, NULL, l_quantity, l_linestatus FROM lineitem WHERE l_returnflag = 'A' AND l_quantity >= 10),
g AS (SELECT l_partkey, l_suppkey, arg_min(l_shipmode, l * 1000000000000 + o) AS status, max(pident) AS pident, max(quality) AS quality, min(evalue) AS evalue,
 max(CASE WHEN l = 0 THEN 1 ELSE 0 END) AS in_sequence, max(CASE WHEN l = 1 THEN 1 ELSE 0 END) AS in_structure FROM u GROUP BY l_partkey, l_suppkey)"""


def _merged(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "lineitem").withColumn("ordinal", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    shared = ["l_partkey", "l_suppkey", "ordinal", F.col("l_linestatus").alias("status"), F.col("l_tax").alias("evalue")]
    sequence = items.where("l_returnflag = 'R'").select(*shared, F.col("l_discount").alias("pident"))
    structure = items.where("l_returnflag = 'A' AND l_quantity >= 10").select(*shared, F.col("l_quantity").alias("quality"))
    best = {"pident": "max", "quality": "max", "evalue": "min"}
    return evidence.merge_sources({"sequence": sequence, "structure": structure}, ["l_partkey", "l_suppkey"], best, ["status"], "ordinal")


@query(f"WITH {_MERGED} SELECT * FROM g")
def evidence_merge(spark: SparkSession, d: str) -> DataFrame:
    return _merged(spark, d)


@query(
    f"""WITH {_MERGED} SELECT l_partkey, l_suppkey, in_sequence + in_structure AS sources, quality, pident FROM g
ORDER BY sources DESC, quality DESC NULLS LAST, pident DESC NULLS LAST, l_partkey, l_suppkey LIMIT 50"""
)
def evidence_report(spark: SparkSession, d: str) -> DataFrame:
    rows = _merged(spark, d).select("l_partkey", "l_suppkey", (F.col("in_sequence") + F.col("in_structure")).alias("sources"), "quality", "pident")
    return rows.orderBy(F.desc("sources"), F.desc_nulls_last("quality"), F.desc_nulls_last("pident"), "l_partkey", "l_suppkey").limit(50)


@query(
    """SELECT o_orderkey, count(l_orderkey) AS n_items, coalesce(string_agg(CAST(l_partkey AS VARCHAR), ';' ORDER BY l_linenumber, l_partkey), '') AS parts
FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey AND l_returnflag = 'R' GROUP BY o_orderkey"""
)
def nested_annotation(spark: SparkSession, d: str) -> DataFrame:
    details = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_partkey")
    found = evidence.annotate(table(spark, d, "orders").select("o_orderkey"), details, ["o_orderkey"], ["l_linenumber", "l_partkey"], "items")
    return found.select("o_orderkey", F.size("items").cast("long").alias("n_items"), F.array_join(F.transform("items", lambda x: x["l_partkey"].cast("string")), ";").alias("parts"))


@query(
    """SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, a.n_chars, b.quality, b.toxic, a.doc_id IS NULL AS only_right, b.doc_id IS NULL AS only_left
FROM documents a FULL JOIN (SELECT doc_id + 3 AS doc_id, quality, toxic FROM labels) b ON a.doc_id = b.doc_id"""
)
def score_collection(spark: SparkSession, d: str) -> DataFrame:
    """Labels are moved by three ids, so that some have no document."""
    a, b = table(spark, d, "documents").alias("a"), table(spark, d, "labels").withColumn("doc_id", F.col("doc_id") + 3).alias("b")
    return a.join(b, F.col("a.doc_id") == F.col("b.doc_id"), "full_outer").select(
        F.coalesce("a.doc_id", "b.doc_id").alias("doc_id"), "a.n_chars", "b.quality", "b.toxic", F.col("a.doc_id").isNull().alias("only_right"), F.col("b.doc_id").isNull().alias("only_left")
    )


@query(
    """WITH s AS (SELECT p_brand, p_partkey, p_retailprice, nullif(p_size, 1) AS size FROM part),
r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS a,
 row_number() OVER (PARTITION BY p_brand, size IS NULL ORDER BY size DESC, p_partkey) AS b FROM s)
SELECT p_brand, p_partkey, round(1.0 / (60 + a) + CASE WHEN size IS NULL THEN 0 ELSE 1.0 / (60 + b) END, 9) AS rrf FROM r"""
)
def rank_fusion(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part").select("p_brand", "p_partkey", "p_retailprice", F.expr("nullif(p_size, 1)").alias("size"))
    return ranking.reciprocal_ranks(part, ["p_brand"], ["p_retailprice", "size"], ["p_partkey"]).select("p_brand", "p_partkey", F.round("rrf", 9).alias("rrf"))


@query(
    """SELECT l_partkey, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey
ORDER BY nullif(l_discount, 0.1) DESC NULLS LAST, nullif(l_tax, 0.08) DESC NULLS LAST, l_orderkey, l_linenumber) AS pl FROM lineitem) WHERE pl = 1"""
)
def tiered_selection(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "lineitem").selectExpr("l_partkey", *KEY, "nullif(l_discount, 0.1D) AS a", "nullif(l_tax, 0.08D) AS b")
    return ranking.tiered_best(items, ["l_partkey"], ["a", "b"], KEY).select("l_partkey", *KEY)


@query(
    """WITH t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_discount DESC, l_orderkey, l_linenumber) AS pl,
max(l_discount) OVER (PARTITION BY l_partkey) AS best FROM lineitem) WHERE pl <= 20)
SELECT l_partkey, l_orderkey, l_linenumber, l_discount FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey
ORDER BY (l_returnflag = 'R' AND best - l_discount < 0.015) DESC, l_discount DESC, l_tax DESC, l_orderkey, l_linenumber) AS pick FROM t) WHERE pick = 1"""
)
def cascaded_selection(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "lineitem")
    found = ranking.cascade(items, ["l_partkey"], "l_discount", "l_tax", F.col("l_returnflag") == "R", KEY, pool=20, margin=0.015)
    return found.select("l_partkey", *KEY, "l_discount")


@query(
    """WITH a AS (SELECT user_id, event_id, value, rank() OVER (PARTITION BY user_id ORDER BY value DESC) + (count(*) OVER (PARTITION BY user_id, value) - 1) / 2 AS ra,
rank() OVER (PARTITION BY user_id ORDER BY k DESC) + (count(*) OVER (PARTITION BY user_id, k) - 1) / 2 AS rb
FROM (SELECT *, CAST(props->>'$.k' AS BIGINT) AS k FROM events) WHERE value IS NOT NULL AND k IS NOT NULL)
SELECT user_id, count(*) AS n, CASE WHEN var_pop(ra) > 0 AND var_pop(rb) > 0 THEN round(corr(ra, rb), 6) END AS rho FROM a GROUP BY user_id HAVING count(*) >= 5"""
)
def rank_correlations(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    return statistics.spearman(events, ["user_id"], "value", "k")


@query(
    """SELECT user_id, event_type, count(value) AS n, round(stddev_pop(value), 6) AS deviation, round(max(value) - min(value), 6) AS range,
round(median(value), 6) AS median, round(quantile_cont(value, 0.75) - quantile_cont(value, 0.25), 6) AS iqr
FROM events GROUP BY user_id, event_type HAVING count(value) > 1"""
)
def spread_statistics(spark: SparkSession, d: str) -> DataFrame:
    return statistics.spread(table(spark, d, "events"), ["user_id", "event_type"], "value")


@query(
    """SELECT c_nationkey, round(median(c_acctbal), 6) AS median_a, round(median(CASE WHEN c_mktsegment <> 'BUILDING' THEN c_custkey END), 6) AS median_b,
round(coalesce((median(c_acctbal) + median(CASE WHEN c_mktsegment <> 'BUILDING' THEN c_custkey END)) / 2, median(c_acctbal)), 6) AS ensemble
FROM customer GROUP BY c_nationkey"""
)
def ensemble_medians(spark: SparkSession, d: str) -> DataFrame:
    return statistics.ensemble(table(spark, d, "customer"), ["c_nationkey"], "c_acctbal", "c_custkey", F.col("c_mktsegment") != "BUILDING")


_SCREEN = """s AS (SELECT d.doc_id, CAST(n_chars AS DOUBLE) AS score, toxic FROM documents d JOIN labels USING (doc_id)),
t AS (SELECT count(*) AS n, sum(toxic) AS p FROM s),
k AS (SELECT *, rank() OVER (ORDER BY score DESC) + (count(*) OVER (PARTITION BY score) - 1) / 2 AS r, row_number() OVER (ORDER BY score DESC, doc_id) AS o FROM s)"""


def _screened(spark: SparkSession, d: str) -> DataFrame:
    docs, labels = table(spark, d, "documents").select("doc_id", F.col("n_chars").cast("double").alias("score")), table(spark, d, "labels")
    return docs.join(labels, "doc_id")


@query(
    f"""WITH {_SCREEN}, x AS (SELECT any_value(n) AS n, any_value(p) AS p, sum(r) FILTER (toxic = 1) AS rs, sum(exp(-20 * r / n)) FILTER (toxic = 1) AS e,
{", ".join(f"sum(toxic) FILTER (o <= greatest(1, round_even(n * {f}, 0))) / max(greatest(1, round_even(n * {f}, 0))) AS h{c}" for c, f in ((1, 0.01), (5, 0.05), (10, 0.1)))} FROM k, t)
SELECT n AS n_rows, CAST(p AS BIGINT) AS n_hits, round(1 - (rs - p * (p + 1) / 2) / (p * (n - p)), 6) AS auc,
round(e / p / ((1 - exp(-20)) / n / (exp(20 / n) - 1)) * (p / n) * ((exp(10) - exp(-10)) / 2)
 / ((exp(10) + exp(-10)) / 2 - (exp(10 - 20 * p / n) + exp(20 * p / n - 10)) / 2) + 1 / (1 - exp(20 * (1 - p / n))), 6) AS bedroc,
round(h1 / (p / n), 6) AS ef1, round(h5 / (p / n), 6) AS ef5, round(h10 / (p / n), 6) AS ef10 FROM x"""
)
def screening_metrics(spark: SparkSession, d: str) -> DataFrame:
    return screening.metrics(_screened(spark, d), "score", "toxic", ["doc_id"])


@query(
    f"""WITH {_SCREEN}, g AS (SELECT score, count(*) AS n, sum(toxic) AS h FROM s GROUP BY score),
c AS (SELECT sum(h) OVER (ORDER BY score DESC) AS tp, sum(n) OVER (ORDER BY score DESC) AS seen FROM g)
SELECT round((seen - tp) / (n - p), 6) AS fpr, round(tp / p, 6) AS tpr FROM c, t UNION ALL SELECT 0.0, 0.0"""
)
def roc_curve(spark: SparkSession, d: str) -> DataFrame:
    return screening.roc_points(_screened(spark, d), "score", "toxic")


RADIUS = 0.06
_POINTS = """e AS (SELECT vec_id, label, vec_id % 4 AS family, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z,
 CAST(vec_id % 3 AS DOUBLE) AS weight FROM embeddings),
d AS (SELECT a.label, a.vec_id AS a, b.vec_id AS b, a.family AS fa, b.family AS fb, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)) AS distance
 FROM e a JOIN e b ON a.label = b.label AND a.vec_id < b.vec_id),
n AS (SELECT * FROM d WHERE distance <= 0.06)"""


def _points(spark: SparkSession, d: str) -> DataFrame:
    axes = [F.get("embedding", F.lit(i)).cast("double").alias(c) for i, c in enumerate(spatial.AXES)]
    return table(spark, d, "embeddings").select("vec_id", "label", (F.col("vec_id") % 4).alias("family"), (F.col("vec_id") % 3).cast("double").alias("weight"), *axes)


@query(f"WITH {_POINTS} SELECT label, a, b, round(distance, 6) AS distance FROM n")
def spatial_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return spatial.neighbours(_points(spark, d), ["label"], "vec_id", RADIUS).withColumn("distance", F.round("distance", 6))


@query(
    f"""WITH RECURSIVE {_POINTS}, both_ways AS (SELECT a, b FROM n UNION ALL SELECT b, a FROM n),
reach(a, b) AS (SELECT vec_id, vec_id FROM e UNION SELECT r.a, w.b FROM reach r JOIN both_ways w ON r.b = w.a),
c AS (SELECT a AS vec_id, min(b) AS cluster FROM reach GROUP BY a)
SELECT label, cluster, count(*) AS size, round(sum(weight), 6) AS evidence,
round(CASE WHEN sum(weight) <> 0 THEN sum(weight * x) / sum(weight) ELSE avg(x) END, 6) AS centre_x,
round(CASE WHEN sum(weight) <> 0 THEN sum(weight * y) / sum(weight) ELSE avg(y) END, 6) AS centre_y,
round(CASE WHEN sum(weight) <> 0 THEN sum(weight * z) / sum(weight) ELSE avg(z) END, 6) AS centre_z
FROM e JOIN c USING (vec_id) GROUP BY label, cluster"""
)
def spatial_clusters(spark: SparkSession, d: str) -> DataFrame:
    return spatial.cluster_summary(spatial.single_link(_points(spark, d), ["label"], "vec_id", RADIUS), ["label"], "weight")


@query(
    f"""WITH {_POINTS}, s AS (SELECT a AS v FROM d WHERE distance < 0.06 AND fa <> fb UNION ALL SELECT b FROM d WHERE distance < 0.06 AND fa <> fb)
SELECT vec_id, label, (SELECT count(*) FROM s WHERE v = vec_id) AS support FROM e"""
)
def consensus_support(spark: SparkSession, d: str) -> DataFrame:
    return spatial.support(_points(spark, d), ["label"], "vec_id", "family", RADIUS)


@query(
    f"""WITH {_POINTS}, w AS (SELECT label, a, b FROM n UNION ALL SELECT label, b, a FROM n UNION ALL SELECT label, vec_id, vec_id FROM e),
c AS (SELECT label, a, count(*) AS neighbours FROM w GROUP BY label, a),
m AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY neighbours DESC, a) AS pl FROM c) WHERE pl = 1)
SELECT m.label, m.a AS vec_id, neighbours, round(avg(x), 6) AS mean_x, round(avg(y), 6) AS mean_y, round(avg(z), 6) AS mean_z
FROM m JOIN w ON w.a = m.a JOIN e ON e.vec_id = w.b GROUP BY m.label, m.a, neighbours"""
)
def density_modes(spark: SparkSession, d: str) -> DataFrame:
    return spatial.density_mode(_points(spark, d), ["label"], "vec_id", RADIUS)


@query(
    """SELECT CASE WHEN n_chars < 100 THEN 0 WHEN n_chars < 500 THEN 1 WHEN n_chars < 2000 THEN 2 WHEN n_chars <= 10000 THEN 3 END AS bin, count(*) AS n
FROM documents GROUP BY 1"""
)
def length_histogram(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return docs.groupBy(statistics.bins(F.col("n_chars"), [0, 100, 500, 2000, 10000]).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT lang, source, count(*) AS n, round(100 * count(*) / sum(count(*)) OVER (PARTITION BY lang), 6) AS percent FROM documents GROUP BY lang, source")
def family_contribution(spark: SparkSession, d: str) -> DataFrame:
    return statistics.contribution(table(spark, d, "documents"), "lang", "source")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def unmatched_anti_join(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").join(table(spark, d, "orders").where("o_orderstatus = 'F'"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query(
    """SELECT CASE WHEN grouping(o_orderstatus) = 1 THEN 'TOTAL' ELSE o_orderstatus END AS status, count(*) AS n, count(*) FILTER (o_totalprice < 50000) AS low,
count(*) FILTER (o_totalprice < 100000) AS mid, min(o_totalprice) AS best FROM orders GROUP BY ROLLUP (o_orderstatus)"""
)
def threshold_totals(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").rollup("o_orderstatus").agg(
        F.grouping("o_orderstatus").alias("g"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("o_totalprice") < 50000).alias("low"),
        F.count_if(F.col("o_totalprice") < 100000).alias("mid"), F.min("o_totalprice").alias("best"),
    ).select(F.when(F.col("g") == 1, "TOTAL").otherwise(F.col("o_orderstatus")).alias("status"), "n", "low", "mid", "best")


@query(
    r"""SELECT p_partkey, CAST(nullif(regexp_extract(n, '_seed[_-](\d+)', 1), '') AS INTEGER) AS seed, CAST(nullif(regexp_extract(n, '_(\d+)$', 1), '') AS INTEGER) AS idx,
CASE WHEN n LIKE 'Brand#1_%' THEN 'Brand#1' WHEN n LIKE 'Brand#2%' THEN 'Brand#2' ELSE n END AS family,
greatest(0.0, least(1.0, 1 - p_size / 40.0)) AS closeness, 9 - p_size / 10.0 AS log_affinity
FROM (SELECT *, p_brand || '_seed_' || CAST(p_size AS VARCHAR) || '_' || CAST(p_partkey AS VARCHAR) AS n FROM part)"""
)
def name_parsing(spark: SparkSession, d: str) -> DataFrame:
    name = F.concat_ws("_", "p_brand", F.lit("seed"), F.col("p_size").cast("string"), F.col("p_partkey").cast("string"))
    return table(spark, d, "part").withColumn("n", name).select(
        "p_partkey", parsing.seed(F.col("n")).alias("seed"), parsing.trailing_index(F.col("n")).alias("idx"),
        parsing.prefix_family(F.col("n"), ["Brand#1", "Brand#2"]).alias("family"),
        parsing.closeness(F.col("p_size") / 40).alias("closeness"), parsing.log_affinity(F.col("p_size") / 10).alias("log_affinity"),
    )


@query(
    """SELECT event_type, round(quantile_cont(value, 0.1), 6) AS p10, round(quantile_cont(value, 0.25), 6) AS p25, round(quantile_cont(value, 0.5), 6) AS p50
FROM events GROUP BY event_type"""
)
def quantile_table(spark: SparkSession, d: str) -> DataFrame:
    return statistics.quantiles(table(spark, d, "events"), ["event_type"], "value", {"p10": 0.1, "p25": 0.25, "p50": 0.5})


@query(
    """SELECT l_suppkey, count(*) AS n, max(l_discount) AS best, round(quantile_cont(l_discount, 0.9), 6) AS p90, round(avg(l_discount), 6) AS mean,
round(avg(CASE WHEN pl <= 10 THEN l_discount END), 6) AS top_mean, round(avg(CASE WHEN l_discount >= 0.05 THEN 1.0 ELSE 0.0 END), 6) AS share,
max(CASE WHEN pl = 1 THEN l_tax END) AS other_at_best
FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_discount DESC, l_orderkey, l_linenumber) AS pl FROM lineitem) GROUP BY l_suppkey"""
)
def signal_rollup(spark: SparkSession, d: str) -> DataFrame:
    return statistics.signal_rollup(table(spark, d, "lineitem"), ["l_suppkey"], "l_discount", "l_tax", KEY, 0.05)


@query(
    """WITH b AS (SELECT l_partkey, l_returnflag, min(l_quantity) AS best FROM lineitem GROUP BY l_partkey, l_returnflag),
g AS (SELECT *, min(best) OVER (PARTITION BY l_partkey) AS low FROM b)
SELECT l_partkey, count(*) FILTER (best <= low + 1) AS within_1, count(*) FILTER (best <= low + 2) AS within_2, count(*) FILTER (best <= low + 5) AS within_5
FROM g GROUP BY l_partkey"""
)
def family_consensus(spark: SparkSession, d: str) -> DataFrame:
    return statistics.families_within(table(spark, d, "lineitem"), ["l_partkey"], "l_returnflag", "l_quantity", [1, 2, 5])


@query(
    """SELECT user_id, event_type, n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, first) AS pl FROM
(SELECT user_id, event_type, count(*) AS n, min(event_id) AS first FROM events WHERE event_type IS NOT NULL GROUP BY user_id, event_type)) WHERE pl = 1"""
)
def majority_vote(spark: SparkSession, d: str) -> DataFrame:
    return statistics.majority(table(spark, d, "events"), ["user_id"], "event_type", "event_id")


@query(
    """WITH c AS (SELECT o_custkey, count(*) AS size FROM orders GROUP BY o_custkey)
SELECT size, count(*) AS clusters, CAST(sum(count(*)) OVER (ORDER BY size DESC) AS BIGINT) AS at_least FROM c GROUP BY size"""
)
def cumulative_support(spark: SparkSession, d: str) -> DataFrame:
    return statistics.cluster_sizes(table(spark, d, "orders"), "o_custkey")


@query(
    """WITH s AS (SELECT user_id, event_type, CASE WHEN event_type = lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) THEN 0 ELSE 1 END AS starts FROM events)
SELECT user_id, event_type, CAST(sum(starts) AS BIGINT) AS runs FROM s GROUP BY user_id, event_type HAVING sum(starts) > 1"""
)
def split_runs(spark: SparkSession, d: str) -> DataFrame:
    return statistics.runs(table(spark, d, "events"), ["user_id"], "event_type", ["ts", "event_id"])


@query(
    f"""WITH {_POINTS} SELECT label, CAST(round_even(x / 0.06, 0) AS BIGINT) AS cell_x, CAST(round_even(y / 0.06, 0) AS BIGINT) AS cell_y,
CAST(round_even(z / 0.06, 0) AS BIGINT) AS cell_z, count(*) AS n FROM e GROUP BY ALL"""
)
def voxel_density(spark: SparkSession, d: str) -> DataFrame:
    return spatial.voxels(_points(spark, d), ["label"], RADIUS)


@query(
    f"""WITH {_POINTS}, a AS (SELECT label, vec_id, (x - 0.1) * (x - 0.1) + (y - 0.1) * (y - 0.1) + (z - 0.1) * (z - 0.1) AS d FROM e)
SELECT label, vec_id, round(sqrt(d), 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY d, vec_id) AS pl FROM a) WHERE pl = 1"""
)
def nearest_to_anchor(spark: SparkSession, d: str) -> DataFrame:
    return spatial.nearest(_points(spark, d), ["label"], "vec_id", [0.1, 0.1, 0.1])


@query(
    """WITH r AS (SELECT *, rank() OVER (PARTITION BY l_partkey ORDER BY l_discount DESC) + (count(*) OVER (PARTITION BY l_partkey, l_discount) - 1) / 2
 + (rank() OVER (PARTITION BY l_partkey ORDER BY l_tax DESC) + (count(*) OVER (PARTITION BY l_partkey, l_tax) - 1) / 2) AS rank_sum FROM lineitem)
SELECT l_partkey, l_orderkey, l_linenumber, rank_sum FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY rank_sum, l_orderkey, l_linenumber) AS pl FROM r) WHERE pl = 1"""
)
def rank_sum_selection(spark: SparkSession, d: str) -> DataFrame:
    found = ranking.rank_sum_best(table(spark, d, "lineitem"), ["l_partkey"], ["l_discount", "l_tax"], KEY)
    return found.select("l_partkey", *KEY, "rank_sum")


@query(
    """SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS n_f, count(*) FILTER (o_orderstatus = 'O') AS n_o, count(*) FILTER (o_orderstatus = 'P') AS n_p
FROM orders GROUP BY o_orderpriority"""
)
def wide_counts(spark: SparkSession, d: str) -> DataFrame:
    wide = table(spark, d, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).count().fillna(0)
    return wide.select("o_orderpriority", *[F.col(s).alias(f"n_{s.lower()}") for s in "FOP"])
