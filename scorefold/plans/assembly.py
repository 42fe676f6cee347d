"""Queries that assemble, filter and complete tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import assembly, evidence, ranking
from ..sources.tables import table
from .catalogue import KEY
from .registry import query

_O = "l_orderkey, l_linenumber"


def _side(spark: SparkSession, d: str, flag: str, value: str, out: str) -> DataFrame:
    rows = table(spark, d, "lineitem").where(F.col("l_returnflag") == flag)
    return rows.select(F.concat(F.lit("pose_"), F.col("l_partkey")).alias("name"), F.col(value).alias(out), *KEY, F.col(value).alias("o"))


def _side_sql(flag: str, value: str, out: str) -> str:
    return f"SELECT 'pose_' || l_partkey AS name, {value} AS {out} FROM lineitem WHERE l_returnflag = '{flag}' QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, {value}) = 1"


@query(f"SELECT coalesce(a.name, b.name) AS name, affinity, deviation FROM ({_side_sql('R', 'l_suppkey', 'affinity')}) a FULL JOIN ({_side_sql('A', 'l_suppkey', 'deviation')}) b ON a.name = b.name")
def canonical_collection(spark: SparkSession, d: str) -> DataFrame:
    return assembly.collect_outer(_side(spark, d, "R", "l_suppkey", "affinity"), _side(spark, d, "A", "l_suppkey", "deviation"), "name", [*KEY, "o"])


@query(
    """WITH c AS (SELECT CASE WHEN s_suppkey % 2 = 0 THEN 'R' ELSE 'A' END AS model, CAST(s_suppkey % 5 AS INTEGER) AS n, max(s_acctbal) AS conf FROM supplier GROUP BY 1, 2),
a AS (SELECT arg_min(conf, n) AS anchor FROM c WHERE model = 'A')
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag AS model, CASE WHEN l_returnflag IN ('R', 'A') THEN conf WHEN l_linestatus = 'O' THEN anchor END AS conf
FROM lineitem LEFT JOIN c ON l_returnflag = model AND l_linenumber = n CROSS JOIN a"""
)
def pose_confidence(spark: SparkSession, d: str) -> DataFrame:
    conf = table(spark, d, "supplier").groupBy(F.when(F.col("s_suppkey") % 2 == 0, "R").otherwise("A").alias("model"), (F.col("s_suppkey") % 5).cast("int").alias("n")).agg(F.max("s_acctbal").alias("conf"))
    poses = table(spark, d, "lineitem").select(*KEY, "l_partkey", "l_suppkey", "l_linestatus", F.col("l_returnflag").alias("model"), F.col("l_linenumber").alias("n"))
    found = assembly.with_confidence(poses, conf, ["model", "n"], F.col("model").isin("R", "A"), F.col("l_linestatus") == "O", F.col("model") == "A", ["conf"])
    return found.select(*KEY, "l_partkey", "l_suppkey", "model", "conf")


@query(
    """SELECT o_orderkey, r, a, n FROM orders LEFT JOIN (SELECT l_orderkey, max(l_discount) AS r FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_orderkey) x ON x.l_orderkey = o_orderkey
LEFT JOIN (SELECT l_orderkey, max(l_discount) AS a FROM lineitem WHERE l_returnflag = 'A' GROUP BY l_orderkey) y ON y.l_orderkey = o_orderkey
LEFT JOIN (SELECT l_orderkey, max(l_discount) AS n FROM lineitem WHERE l_returnflag = 'N' GROUP BY l_orderkey) z ON z.l_orderkey = o_orderkey"""
)
def three_scores(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    scores = {f.lower(): items.where(F.col("l_returnflag") == f).groupBy("o_orderkey").agg(F.max("l_discount").alias("v")) for f in "RAN"}
    return assembly.assemble(table(spark, d, "orders").select("o_orderkey"), scores, "o_orderkey", "v")


@query(
    """SELECT c_custkey, n_name AS zone FROM (SELECT c_custkey, regexp_replace('N' || c_nationkey || '_input', '_input$', '') AS k FROM customer)
LEFT JOIN (SELECT 'N' || n_nationkey AS k, n_name FROM nation WHERE n_nationkey % 7 <> 0) USING (k)"""
)
def zones_attached(spark: SparkSession, d: str) -> DataFrame:
    named = table(spark, d, "customer").select("c_custkey", F.regexp_replace(F.concat(F.lit("N"), "c_nationkey", F.lit("_input")), "_input$", "").alias("k"))
    zones = table(spark, d, "nation").where("n_nationkey % 7 <> 0").select(F.concat(F.lit("N"), "n_nationkey").alias("k"), F.col("n_name").alias("zone"))
    return named.join(zones, "k", "left").select("c_custkey", "zone")


@query(
    """WITH p AS (SELECT p_partkey AS l_partkey, p_partkey % 100 + 1 AS l_suppkey FROM part), t AS (SELECT *, (l_orderkey * 10 + l_linenumber) * 1000 + l_quantity AS o FROM lineitem),
e AS (SELECT l_partkey, l_suppkey, arg_min(l_quantity, o) AS q FROM t GROUP BY l_partkey, l_suppkey), f AS (SELECT l_partkey, arg_min(l_quantity, o) AS q FROM t GROUP BY l_partkey)
SELECT p.l_partkey, p.l_suppkey, coalesce(e.q, f.q) AS l_quantity FROM p LEFT JOIN e ON p.l_partkey = e.l_partkey AND p.l_suppkey = e.l_suppkey LEFT JOIN f ON p.l_partkey = f.l_partkey"""
)
def truth_lookup(spark: SparkSession, d: str) -> DataFrame:
    picks = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), (F.col("p_partkey") % 100 + 1).alias("l_suppkey"))
    return assembly.truth_with_fallback(picks, table(spark, d, "lineitem"), ["l_partkey", "l_suppkey"], ["l_partkey"], "l_quantity", [*KEY, "l_quantity"])


@query(
    """WITH r AS (SELECT n_regionkey AS g, p_partkey AS k, p_type AS code, p_size AS size FROM part JOIN nation ON n_nationkey = p_partkey % 25 WHERE p_partkey % 9 = 0),
q AS (SELECT n_regionkey AS g, p_partkey AS k, p_brand || p_type AS c2, p_type AS code, p_size AS size FROM part JOIN nation ON n_nationkey = p_partkey % 25 WHERE p_partkey % 9 > 0)
SELECT q.k, coalesce((SELECT min(r.k) FROM r WHERE r.g = q.g AND r.code = q.code AND q.k % 2 = 0), (SELECT arg_min(r.k, CAST(abs(r.size - q.size) AS BIGINT) * 1000000000 + r.k) FROM r WHERE r.g = q.g)) AS ref FROM q"""
)
def reference_match(spark: SparkSession, d: str) -> DataFrame:
    """Every ninth part is a reference; odd keys of the others have a code that no reference has."""
    nation = table(spark, d, "nation").select((F.col("n_nationkey").cast("long")).alias("_n"), F.col("n_regionkey").alias("g"))
    parts = table(spark, d, "part").withColumn("_n", F.col("p_partkey") % 25).join(nation, "_n").select("g", F.col("p_partkey").alias("k"), F.col("p_type").alias("code"), F.col("p_size").alias("size"))
    rows = parts.where("k % 9 > 0").withColumn("code", F.when(F.col("k") % 2 == 0, F.col("code")).otherwise(F.lit("none")))
    return assembly.matched_or_nearest(rows, parts.where("k % 9 = 0"), "g", "code", "size", "k").select("k", "ref")


@query(
    """SELECT p_brand, p_partkey, p_retailprice FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS pl FROM part
WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity < 3)) WHERE pl = 1"""
)
def representative_hits(spark: SparkSession, d: str) -> DataFrame:
    hits = table(spark, d, "lineitem").where("l_quantity < 3").select(F.col("l_partkey").alias("p_partkey")).distinct()
    return assembly.representative_hits(table(spark, d, "part").select("p_brand", "p_partkey", "p_retailprice"), hits, "p_brand", "p_partkey", "p_retailprice")


@query(
    f"""WITH l AS (SELECT l_partkey, l_returnflag, l_discount, row_number() OVER (PARTITION BY l_partkey, l_returnflag ORDER BY l_discount DESC, {_O}) AS rank FROM lineitem)
SELECT a.l_partkey, a.rank, a.l_discount AS l_discount_A, r.l_discount AS l_discount_R FROM l a JOIN l r ON a.l_partkey = r.l_partkey AND a.rank = r.rank AND a.l_returnflag = 'A' AND r.l_returnflag = 'R'"""
)
def rank_zipped_models(spark: SparkSession, d: str) -> DataFrame:
    lists = table(spark, d, "lineitem").withColumn("rank", ranking.place(["l_partkey", "l_returnflag"], F.desc("l_discount"), *map(F.asc, KEY))).where("l_returnflag <> 'N'")
    return assembly.rank_zip(lists, "l_partkey", "l_returnflag", "rank", ["A", "R"], "l_discount")


@query(
    """SELECT c_custkey, o_orderkey, seed FROM (SELECT *, row_number() OVER (PARTITION BY c_custkey, seed IS NULL ORDER BY seed, o_orderkey) AS pl
FROM (SELECT o_custkey AS c_custkey, o_orderkey, nullif(o_orderkey % 5, 0) AS seed FROM orders)) WHERE pl = 1 OR seed IS NULL"""
)
def seed_reduction(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", F.nullif(F.col("o_orderkey") % 5, F.lit(0)).alias("seed"))
    return assembly.lowest_seeds(rows, "c_custkey", "seed", ["o_orderkey"])


@query(
    """SELECT o_custkey, o_orderkey FROM (SELECT *, max(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) OVER (PARTITION BY o_custkey) AS any_f FROM orders) WHERE o_orderstatus = 'F' OR any_f = 0"""
)
def source_or_all(spark: SparkSession, d: str) -> DataFrame:
    return assembly.with_fallback(table(spark, d, "orders"), ["o_custkey"], F.col("o_orderstatus") == "F").select("o_custkey", "o_orderkey")


@query("SELECT p_brand, p_partkey, CAST(pl % 4 AS INTEGER) AS chunk, pl % 3 = 0 AS strided FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS pl FROM part)")
def chunks(spark: SparkSession, d: str) -> DataFrame:
    return assembly.chunk(table(spark, d, "part"), ["p_brand"], ["p_partkey"], 4, 3).select("p_brand", "p_partkey", "chunk", "strided")


@query(
    """SELECT o_orderkey, count(*) AS n_items, sum(l_quantity) AS total FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE coalesce(nullif(o_orderdate, TIMESTAMP '1995-01-01') >= TIMESTAMP '1994-01-01', true)
AND l_returnflag IN ('R', 'A') GROUP BY o_orderkey HAVING count(*) >= 1 AND sum(l_quantity) BETWEEN 20 AND 100"""
)
def eligible_inputs(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").where("coalesce(nullif(o_orderdate, timestamp_ntz'1995-01-01') >= timestamp_ntz'1994-01-01', true)").select("o_orderkey")
    items = table(spark, d, "lineitem").where(F.col("l_returnflag").isin("R", "A")).groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n_items"), F.sum("l_quantity").alias("total"))
    return orders.join(items.where("n_items >= 1 AND total BETWEEN 20 AND 100"), "o_orderkey")


@query("SELECT l_returnflag, count(*) AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE coalesce(nullif(o_orderdate, TIMESTAMP '1995-03-05') < TIMESTAMP '1995-01-01', true) GROUP BY l_returnflag")
def before_cutoff(spark: SparkSession, d: str) -> DataFrame:
    dated = table(spark, d, "orders").selectExpr("o_orderkey AS l_orderkey", "cast(nullif(o_orderdate, timestamp_ntz'1995-03-05') AS date) AS day")
    rows = evidence.before(dated, "day", "1995-01-01")
    return table(spark, d, "lineitem").join(rows, "l_orderkey").groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"))


@query(
    """WITH s AS (SELECT CASE WHEN p_partkey % 3 = 0 THEN 'b' || p_size || '_L' ELSE 'b' || p_size END AS name FROM part) SELECT name, count(*) AS n FROM s
WHERE NOT EXISTS (SELECT 1 FROM s x WHERE x.name = s.name || '_L') GROUP BY name"""
)
def superseded_names(spark: SparkSession, d: str) -> DataFrame:
    size = F.concat(F.lit("b"), F.col("p_size"))
    rows = table(spark, d, "part").select(F.when(F.col("p_partkey") % 3 == 0, F.concat(size, F.lit("_L"))).otherwise(size).alias("name"))
    return evidence.without_superseded(rows, "name", "_L$").groupBy("name").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'")
def intersection(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders")
    return orders.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("k")).intersect(orders.where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("k")))


@query("SELECT l_orderkey, count(DISTINCT l_returnflag) FILTER (l_returnflag IN ('A', 'R')) = 2 AS has_both FROM lineitem GROUP BY l_orderkey")
def superset_test(spark: SparkSession, d: str) -> DataFrame:
    held = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_returnflag").alias("held"))  # of three flags
    return held.select("l_orderkey", (F.size(F.array_except(F.array(F.lit("A"), F.lit("R")), "held")) == 0).alias("has_both"))


@query("SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY user_id, event_type")
def ordered_dedup(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").withColumn("_at", ranking.place(["user_id", "event_type"], F.asc("event_id")))
    return rows.where("_at = 1").select("user_id", "event_type", "event_id")


@query("SELECT p_type AS rep, count(*) AS members, min(p_partkey) AS first, max(p_partkey) AS last FROM part GROUP BY p_type")
def cluster_members(spark: SparkSession, d: str) -> DataFrame:
    members = table(spark, d, "part").select(F.col("p_type").alias("rep"), F.col("p_partkey").alias("member"))
    return members.groupBy("rep").agg(F.count(F.lit(1)).alias("members"), F.min("member").alias("first"), F.max("member").alias("last"))


@query("SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, regexp_extract(url, '://([^/:?#]+)', 1) AS host, len(regexp_extract_all(html, '<a ', 0)) AS links FROM pages")
def page_links(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "pages")
    return pages.select(
        "page_id", F.regexp_extract("url", "^([a-z]+)://", 1).alias("scheme"), F.regexp_extract("url", "://([^/:?#]+)", 1).alias("host"),
        F.size(F.regexp_extract_all("html", F.lit("<a "), F.lit(0))).alias("links"),
    )
