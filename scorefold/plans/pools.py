"""Queries on pools of candidates; a part is a target, its line items are its candidates, quantity is the truth."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluation, pools, screening, statistics
from ..sources.tables import table
from .catalogue import _RANKED, _SCREEN, KEY, NATIVE, _screened, _target_outcomes
from .registry import query

_ITEMS = "i AS (SELECT *, l_returnflag || l_linestatus AS family FROM lineitem)"
_ORDER = "l_orderkey, l_linenumber"


def _items(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").withColumn("family", F.concat("l_returnflag", "l_linestatus"))


def _pool_sql(name: str, score: str, pool: str) -> str:
    return f"""SELECT '{name}' AS scorer, count(*) AS n, round(avg(pool), 6) AS mean_pool, count(*) FILTER (top1 < 5) AS top1_hits, count(*) FILTER (best5 < 5) AS best5_hits,
count(*) FILTER (top1 < 2) AS tight_hits FROM (SELECT l_partkey, count(*) AS pool, min(CASE WHEN pl = 1 THEN l_quantity END) AS top1, min(CASE WHEN pl <= 5 THEN l_quantity END) AS best5
FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY {score} DESC, {_ORDER}) AS pl FROM lineitem WHERE {pool} AND {score} IS NOT NULL) GROUP BY l_partkey)"""


@query(" UNION ALL ".join([_pool_sql("all", "l_discount", "true"), _pool_sql("open", "l_tax", "l_linestatus = 'O'"), _pool_sql("returned", "nullif(l_discount, 0.05)", "l_returnflag = 'R'")]))
def scorer_pools(spark: SparkSession, d: str) -> DataFrame:
    scorers = {
        "all": (F.col("l_discount"), F.lit(True)),
        "open": (F.col("l_tax"), F.col("l_linestatus") == "O"),
        "returned": (F.nullif(F.col("l_discount"), F.lit(0.05)), F.col("l_returnflag") == "R"),
    }
    return pools.scorer_pools(_items(spark, d), "l_partkey", scorers, "l_quantity", KEY, NATIVE, 2.0)


@query(
    f"""WITH {_ITEMS} SELECT family, count(*) AS n, count(*) FILTER (l_quantity < 5) AS natives, count(*) FILTER (l_quantity < 2) AS tight, min(l_quantity) AS least,
list_sort(list(l_quantity))[count(*) // 2 + 1] AS median, round(100.0 * count(*) FILTER (l_quantity < 5) / count(*), 6) AS percent FROM i GROUP BY family"""
)
def family_pose_stats(spark: SparkSession, d: str) -> DataFrame:
    return pools.family_stats(_items(spark, d), "family", "l_quantity", NATIVE, 2.0)


@query(
    f"""WITH {_ITEMS} SELECT family, count(*) AS targets, count(*) FILTER (best < 5) AS recalled
FROM (SELECT family, l_partkey, min(l_quantity) AS best FROM i GROUP BY family, l_partkey) GROUP BY family"""
)
def family_recall(spark: SparkSession, d: str) -> DataFrame:
    return pools.family_recall(_items(spark, d), "family", "l_partkey", "l_quantity", NATIVE)


def _pick_sql(score: str) -> str:
    return f"""SELECT '{score}' AS scorer, family, count(*) AS picks, count(*) FILTER (l_quantity < 5) AS hits
FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY {score} DESC, {_ORDER}) AS pl FROM i) WHERE pl = 1 GROUP BY family"""


@query(
    f"""WITH {_ITEMS}, p AS ({_pick_sql("l_discount")} UNION ALL {_pick_sql("l_tax")})
SELECT *, round(100.0 * picks / sum(picks) OVER (PARTITION BY scorer), 6) AS share, round(100.0 * hits / picks, 6) AS hit_rate FROM p"""
)
def pick_distribution(spark: SparkSession, d: str) -> DataFrame:
    return pools.picks_by_family(_items(spark, d), "l_partkey", "family", ["l_discount", "l_tax"], "l_quantity", KEY, NATIVE)


@query(
    """SELECT p_brand, p_partkey, p_retailprice, round(row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey) / count(*) OVER (PARTITION BY p_brand), 6) AS cdf FROM part"""
)
def empirical_cdf(spark: SparkSession, d: str) -> DataFrame:
    return pools.empirical_cdf(table(spark, d, "part"), ["p_brand"], "p_retailprice", ["p_partkey"])


@query(
    f"""WITH {_ITEMS}, b AS (SELECT l_partkey, family, min(l_quantity) AS best FROM i GROUP BY l_partkey, family),
t AS (SELECT l_partkey, count(*) FILTER (best <= low + 2) AS n_families, min(low) AS low FROM (SELECT *, min(best) OVER (PARTITION BY l_partkey) AS low FROM b) GROUP BY l_partkey)
SELECT n_families, count(*) AS targets, count(*) FILTER (low < 2) AS recovered, count(*) - count(*) FILTER (low < 2) AS false_alarms,
round(100.0 * count(*) FILTER (low < 2) / count(*), 6) AS percent FROM t GROUP BY n_families"""
)
def consensus_outcomes(spark: SparkSession, d: str) -> DataFrame:
    return pools.consensus_outcomes(_items(spark, d), "l_partkey", "family", "l_quantity", 2.0, 2.0)


@query(
    f"""WITH {_ITEMS}, t AS (SELECT l_partkey, min(l_quantity) AS best, arg_min(family, l_quantity * 10 + CASE family WHEN 'AF' THEN 0 WHEN 'AO' THEN 1 WHEN 'NF' THEN 2 WHEN 'NO' THEN 3 WHEN 'RF' THEN 4 ELSE 5 END) AS best_family,
 min(CASE WHEN l_linestatus = 'O' THEN l_quantity END) AS a, min(CASE WHEN l_linestatus <> 'O' THEN l_quantity END) AS b FROM i GROUP BY l_partkey)
SELECT best_family, CASE WHEN best < 3 THEN 0 WHEN best < 5 THEN 1 ELSE 2 END AS bin, count(*) AS targets,
count(*) FILTER (coalesce(a < 3, false) AND NOT coalesce(b < 3, false)) AS first_rescues, count(*) FILTER (coalesce(b < 3, false) AND NOT coalesce(a < 3, false)) AS second_rescues FROM t GROUP BY 1, 2"""
)
def sampling_diagnosis(spark: SparkSession, d: str) -> DataFrame:
    return pools.sampling_diagnosis(_items(spark, d), "l_partkey", "family", F.col("l_linestatus") == "O", "l_quantity", [3.0, 5.0])


@query(
    f"""WITH {_ITEMS} SELECT family, p_type, count(*) AS n, count(*) FILTER (l_quantity < 5) AS natives, round(count(*) FILTER (l_quantity < 5) / count(*), 6) AS rate
FROM i JOIN part ON l_partkey = p_partkey GROUP BY family, p_type HAVING count(*) >= 200"""
)
def native_rates(spark: SparkSession, d: str) -> DataFrame:
    joined = _items(spark, d).join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return pools.native_rates(joined, ["family", "p_type"], "l_quantity", NATIVE, 200)


@query(
    f"""WITH {_ITEMS}, s AS (SELECT l_partkey, family, max(l_quantity) - min(l_quantity) AS spread FROM i GROUP BY l_partkey, family HAVING count(*) > 1)
SELECT family, count(*) AS groups, max(spread) AS widest, list_sort(list(spread))[count(*) // 2 + 1] AS median FROM s GROUP BY family"""
)
def family_spreads(spark: SparkSession, d: str) -> DataFrame:
    return pools.family_spreads(_items(spark, d), "l_partkey", "family", "l_quantity")


_OUT = f"""{_RANKED}, o AS (SELECT target, min(CASE WHEN pl = 1 THEN truth END) AS top1, min(CASE WHEN pl <= 5 THEN truth END) AS top5, min(truth) AS oracle FROM r GROUP BY target),
q AS (SELECT * FROM o JOIN m USING (target))"""


@query(
    f"""WITH {_OUT} SELECT zone, oracle_native, count(*) AS n, round(avg(top1 - oracle), 6) AS mean_to_oracle, round(avg(top1 - top5), 6) AS mean_to_top5,
count(*) FILTER (top1 - top5 > 1) AS wide FROM q GROUP BY zone, oracle_native"""
)
def gap_columns(spark: SparkSession, d: str) -> DataFrame:
    return pools.gaps(_target_outcomes(spark, d), ["zone"], 1.0)


@query(
    f"""WITH {_OUT}, w AS (SELECT *, top1 - oracle AS miss FROM q WHERE oracle_native AND NOT top1_native),
c AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY miss DESC, target) AS pl FROM w),
z AS (SELECT *, row_number() OVER (PARTITION BY zone ORDER BY miss DESC, target) AS rank FROM c WHERE pl = 1)
SELECT zone, rank, target, cluster, miss FROM z WHERE rank <= 10"""
)
def recoverable_targets(spark: SparkSession, d: str) -> DataFrame:
    return pools.recoverable(_target_outcomes(spark, d), "target", "cluster", "zone", 10)


@query(
    f"""WITH s AS (SELECT 'discount' AS strategy, nullif(l_discount, 0.1) AS score, * FROM lineitem UNION ALL SELECT 'tax', nullif(l_tax, 0.08), * FROM lineitem
UNION ALL SELECT 'returned', CASE WHEN l_returnflag = 'R' THEN l_discount END, * FROM lineitem),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY strategy, l_partkey ORDER BY score DESC, {_ORDER}) AS pl FROM s WHERE score IS NOT NULL) WHERE pl = 1),
g AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY l_partkey) AS c FROM f) WHERE c = 3)
SELECT strategy, 'all' AS subset, count(*) AS n, count(*) FILTER (l_quantity < 5) AS hits FROM g GROUP BY strategy
UNION ALL SELECT strategy, 'odd', count(*), count(*) FILTER (l_quantity < 5) FROM g WHERE l_partkey % 2 = 1 GROUP BY strategy"""
)
def ranker_ablation(spark: SparkSession, d: str) -> DataFrame:
    strategies = {"discount": F.expr("nullif(l_discount, 0.1D)"), "tax": F.expr("nullif(l_tax, 0.08D)"), "returned": F.expr("CASE WHEN l_returnflag = 'R' THEN l_discount END")}
    subsets = {"all": F.lit(True), "odd": F.col("l_partkey") % 2 == 1}
    return pools.fair_ablation(table(spark, d, "lineitem"), "l_partkey", strategies, subsets, "l_quantity", KEY, NATIVE)


@query("SELECT CASE WHEN l_discount >= 0.07 THEN 'high' WHEN l_discount >= 0.05 THEN 'middle' ELSE 'low' END AS tier, count(*) AS n, count(DISTINCT l_suppkey) AS distinct FROM lineitem GROUP BY 1")
def confidence_tiers(spark: SparkSession, d: str) -> DataFrame:
    return pools.tiers(table(spark, d, "lineitem"), F.col("l_discount"), 0.07, 0.05, "l_suppkey")


@query("SELECT event_type, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, event_type) AS place FROM events GROUP BY event_type")
def status_counts(spark: SparkSession, d: str) -> DataFrame:
    return pools.value_counts(table(spark, d, "events"), "event_type")


@query(
    """WITH s AS (SELECT p_size AS cluster, count(*) AS size FROM part GROUP BY p_size)
SELECT count(*) AS clusters, max(size) AS largest, arg_min(cluster, -size * 1000 + cluster) AS largest_cluster, count(*) FILTER (size = 1) AS singletons FROM s"""
)
def cluster_headline(spark: SparkSession, d: str) -> DataFrame:
    return pools.headline(table(spark, d, "part").withColumnRenamed("p_size", "cluster"), "cluster")


@query(
    """SELECT l_partkey, count(*) AS n, count(DISTINCT l_suppkey) AS n_distinct, max(l_discount) AS best_l_discount, max(l_tax) AS best_l_tax,
max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS flagged FROM lineitem GROUP BY l_partkey"""
)
def template_rollup(spark: SparkSession, d: str) -> DataFrame:
    return pools.group_rollup(table(spark, d, "lineitem"), "l_partkey", "l_suppkey", ["l_discount", "l_tax"], F.col("l_returnflag") == "R")


@query(
    """WITH m AS (SELECT l_partkey, count(DISTINCT l_linestatus) AS n_models, round(avg(l_discount), 6) AS mean_identity, max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS has_flag,
 round(avg(l_quantity), 6) AS mean_quality FROM lineitem GROUP BY l_partkey)
SELECT * FROM m ORDER BY n_models DESC, has_flag DESC, mean_quality DESC, l_partkey LIMIT 50"""
)
def model_consensus(spark: SparkSession, d: str) -> DataFrame:
    found = table(spark, d, "lineitem").groupBy("l_partkey").agg(
        F.count_distinct("l_linestatus").alias("n_models"), F.round(F.avg("l_discount"), 6).alias("mean_identity"),
        F.max((F.col("l_returnflag") == "R").cast("int")).alias("has_flag"), F.round(F.avg("l_quantity"), 6).alias("mean_quality"),
    )
    return found.orderBy(F.desc("n_models"), F.desc("has_flag"), F.desc("mean_quality"), "l_partkey").limit(50)


@query(
    f"""WITH {_ITEMS}, b AS (SELECT family AS source, l_quantity AS distance FROM i UNION ALL SELECT 'ALL', l_quantity FROM i)
SELECT source, count(distance) AS n, count(*) FILTER (distance <= 5) AS hits, list_sort(list(distance))[count(*) // 2 + 1] AS median FROM b GROUP BY source"""
)
def site_recall(spark: SparkSession, d: str) -> DataFrame:
    rows = _items(spark, d).select(F.col("family").alias("source"), F.col("l_quantity").alias("distance"))
    return pools.site_recall(rows, "source", "distance", 5.0)


@query(
    """WITH b AS (SELECT l_partkey, p_type, min(l_quantity) AS best FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_linestatus = 'O' GROUP BY l_partkey, p_type)
SELECT p_type, count(*) AS targets, min(best) AS least, round(avg(CASE WHEN best < 3 THEN 1.0 ELSE 0.0 END), 6) AS native_share FROM b GROUP BY p_type"""
)
def best_of_family(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").where("l_linestatus = 'O'").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    best = rows.groupBy("l_partkey", "p_type").agg(F.min("l_quantity").alias("best"))
    return best.groupBy("p_type").agg(F.count(F.lit(1)).alias("targets"), F.min("best").alias("least"), evaluation.rate(F.col("best") < 3).alias("native_share"))


@query(
    """SELECT user_id, round(avg(value), 6) AS mean_probability, round(max(value), 6) AS best_probability, round(-min(value / 10), 6) AS best_affinity, round(-avg(value / 10), 6) AS mean_affinity
FROM events GROUP BY user_id"""
)
def affinity_rollup(spark: SparkSession, d: str) -> DataFrame:
    low = F.col("value") / 10
    return table(spark, d, "events").groupBy("user_id").agg(
        F.round(F.avg("value"), 6).alias("mean_probability"), F.round(F.max("value"), 6).alias("best_probability"),
        F.round(-F.min(low), 6).alias("best_affinity"), F.round(-F.avg(low), 6).alias("mean_affinity"),
    )


@query(
    """WITH s AS (SELECT o_orderkey, avg(l_tax * 100) AS d FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey AND l_returnflag = 'R' GROUP BY o_orderkey)
SELECT o_orderkey, round(CASE WHEN d IS NULL THEN 50 ELSE greatest(0.0, least(100.0, 100 - 20 * d)) END, 6) AS confidence FROM s"""
)
def spread_confidence(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.avg(F.col("l_tax") * 100).alias("d"))
    return table(spark, d, "orders").join(items, "o_orderkey", "left").select("o_orderkey", F.round(pools.confidence(F.col("d")), 6).alias("confidence"))


@query(
    """SELECT c_nationkey, round(quantile_cont(c_acctbal, 0.05), 6) AS p05, round(median(c_acctbal), 6) AS p50, round(quantile_cont(c_acctbal, 0.95), 6) AS p95, max(c_acctbal) AS largest
FROM customer GROUP BY c_nationkey"""
)
def variation_summary(spark: SparkSession, d: str) -> DataFrame:
    customer, shares = table(spark, d, "customer"), {"p05": 0.05, "p50": 0.5, "p95": 0.95}
    largest = customer.groupBy("c_nationkey").agg(F.max("c_acctbal").alias("largest"))
    return largest.join(statistics.quantiles(customer, ["c_nationkey"], "c_acctbal", shares), "c_nationkey")


@query(
    """SELECT label, count(x) AS n_aligned, count(*) - count(x) AS n_skipped, max(x) AS worst, list_sort(list(x) FILTER (x IS NOT NULL))[count(x) // 2 + 1] AS median
FROM (SELECT label, nullif(vec_id % 13, 4)::DOUBLE AS x FROM embeddings) GROUP BY label"""
)
def alignment_summary(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings").select("label", F.nullif(F.col("vec_id") % 13, F.lit(4)).cast("double").alias("x"))
    counts = rows.groupBy("label").agg(F.count("x").alias("n_aligned"), (F.count(F.lit(1)) - F.count("x")).alias("n_skipped"), F.max("x").alias("worst"))
    return counts.join(pools.upper_medians(rows, ["label"], ["x"]).withColumnRenamed("x", "median"), "label")


@query(f"WITH {_SCREEN} SELECT doc_id, round(o / n, 6) AS fraction, round(sum(toxic) OVER (ORDER BY o) / p, 6) AS recall FROM k, t")
def enrichment_curve(spark: SparkSession, d: str) -> DataFrame:
    return screening.enrichment(_screened(spark, d), "score", "toxic", ["doc_id"])


@query(f"WITH {_SCREEN}, c AS (SELECT o / n AS fraction, sum(toxic) OVER (ORDER BY o) / p AS recall FROM k, t) SELECT round(min(recall), 6) AS recall FROM c WHERE fraction >= 0.05")
def early_recall(spark: SparkSession, d: str) -> DataFrame:
    return screening.recall_at(_screened(spark, d), "score", "toxic", ["doc_id"], 0.05)


@query(
    f"""WITH {_SCREEN}, a AS (SELECT lang, toxic, rank() OVER w + (count(*) OVER (PARTITION BY lang, score) - 1) / 2 AS r FROM (SELECT lang, toxic, score FROM s JOIN documents USING (doc_id) WHERE n_chars > 500)
 WINDOW w AS (PARTITION BY lang ORDER BY score DESC))
SELECT lang, count(*) AS n, CAST(sum(toxic) AS BIGINT) AS hits, CASE WHEN sum(toxic) > 0 AND sum(toxic) < count(*) THEN
 round((sum(CASE WHEN toxic = 1 THEN count_ + 1 - r END) - sum(toxic) * (sum(toxic) + 1) / 2) / (sum(toxic) * (count(*) - sum(toxic))), 6) END AS auc
FROM (SELECT *, count(*) OVER (PARTITION BY lang) AS count_ FROM a) GROUP BY lang"""
)
def covered_auc(spark: SparkSession, d: str) -> DataFrame:
    """Coverage-restricted: only documents whose signal is present (over 500 characters) are ranked, each language by itself."""
    rows = _screened(spark, d).join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id").where("score > 500")
    return screening.grouped_auc(rows, ["lang"], "score", "toxic")
