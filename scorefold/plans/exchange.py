"""Queries on selections by exchange, clusters at several cutoffs, folds that walk an order, spread picks and frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import anchored, assembly, contacts, evidence, forest, lineage, ranking, running, spatial, spread, statistics, superposition
from ..sources import files
from ..sources.tables import table
from . import geometry  # noqa: F401  registers the SQL that superposed_frames is held against
from .catalogue import _POINTS, RADIUS, _points
from .registry import ORACLE_SQL, query


def _poses(spark: SparkSession, d: str) -> DataFrame:
    """Points with a score, NULL for some, the vector of their three coordinates and a size of their group."""
    score = F.when(F.col("vec_id") % 11 != 0, (F.col("vec_id") * 37 % 101).cast("double") / 100)
    return _points(spark, d).withColumns({"score": score, "point": F.array(*spatial.AXES), "heavy": 10 + 3 * F.col("label")})


def _anchors(spark: SparkSession, d: str) -> DataFrame:
    """Every fortieth point or so is an anchor; label 9 has none."""
    rows = _points(spark, d).where("vec_id % 37 = 1 AND label < 9")
    kind = F.when(F.col("vec_id") % 2 == 0, "template_site").otherwise("residue")
    return rows.select("label", F.col("vec_id").alias("anchor"), *spatial.AXES, (1 + F.col("vec_id") % 5 / 4).alias("weight"), kind.alias("kind"))


@query(None)
def anchored_selection(spark: SparkSession, d: str) -> DataFrame:
    """Exchanges in turn: held against a plain loop in the tests."""
    found = anchored.anchored_top_k(_poses(spark, d), _anchors(spark, d), ["label"], "vec_id", "score", "point", "heavy", distance=0.15, decay=0.2, cover=0.12)
    return found.withColumn("effective", F.round("effective", 6))


@query(None)
def forced_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Two members within reach of an anchor, in sets chosen by score alone: held against a plain loop in the tests."""
    poses = _poses(spark, d)
    near = contacts.pairs(poses, _anchors(spark, d).withColumn("vec_id", F.col("anchor")), ["label"], "vec_id", 0.12).select("label", F.col("a").alias("vec_id")).distinct()
    pool = poses.join(near.withColumn("near", F.lit(True)), ["label", "vec_id"], "left")
    chosen = ranking.diverse_top_k(poses, ["label"], "score", "point", "vec_id", 5, 0.15)
    return anchored.forced_coverage(pool, chosen, ["label"], "vec_id", "score", "point", F.col("near"), 2, distance=0.15)


CUTOFFS = [0.03, 0.05, 0.07, 0.09]


@query(
    f"""WITH RECURSIVE {_POINTS}, t AS (SELECT unnest({CUTOFFS}) AS cutoff), w AS (SELECT cutoff, a, b FROM d, t WHERE distance <= cutoff UNION ALL SELECT cutoff, b, a FROM d, t WHERE distance <= cutoff),
reach(cutoff, a, b) AS (SELECT cutoff, vec_id, vec_id FROM e, t UNION SELECT r.cutoff, r.a, w.b FROM reach r JOIN w ON r.b = w.a AND r.cutoff = w.cutoff),
c AS (SELECT cutoff, a AS vec_id, min(b) AS cluster FROM reach GROUP BY cutoff, a), s AS (SELECT label, cutoff, cluster, count(*) AS size FROM c JOIN e USING (vec_id) GROUP BY label, cutoff, cluster)
SELECT label, cutoff, count(*) AS clusters, max(size) AS largest, count(*) FILTER (size > 1) AS joined FROM s GROUP BY label, cutoff"""
)
def clusters_by_cutoff(spark: SparkSession, d: str) -> DataFrame:
    found = forest.single_link_cutoffs(_points(spark, d), ["label"], "vec_id", CUTOFFS)
    sizes = found.groupBy("label", "cutoff", "cluster").agg(F.count(F.lit(1)).alias("size"))
    return sizes.groupBy("label", "cutoff").agg(F.count(F.lit(1)).alias("clusters"), F.max("size").alias("largest"), F.count_if(F.col("size") > 1).alias("joined"))


def _local(spark: SparkSession, d: str) -> DataFrame:
    """Points with keys from 1 in each label."""
    return _points(spark, d).withColumn("number", ranking.place(["label"], F.asc("vec_id")))


_LOCAL = f"WITH RECURSIVE {_POINTS}, l AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS number FROM e)"


@query(
    f"""{_LOCAL}, both_ways AS (SELECT a, b FROM n UNION ALL SELECT b, a FROM n),
reach(a, b) AS (SELECT vec_id, vec_id FROM e UNION SELECT r.a, w.b FROM reach r JOIN both_ways w ON r.b = w.a)
SELECT label, number, (SELECT number FROM l k WHERE k.vec_id = c.b) AS cluster FROM (SELECT a, min(b) AS b FROM reach GROUP BY a) c JOIN l ON c.a = vec_id"""
)
def local_clusters(spark: SparkSession, d: str) -> DataFrame:
    return spatial.single_link(_local(spark, d), ["label"], "number", RADIUS).select("label", "number", "cluster")


@query(
    f"""{_LOCAL}, s AS (SELECT a AS v FROM d WHERE distance < 0.06 AND fa <> fb UNION ALL SELECT b FROM d WHERE distance < 0.06 AND fa <> fb)
SELECT number, label, (SELECT count(*) FROM s WHERE v = vec_id) AS support FROM l"""
)
def local_support(spark: SparkSession, d: str) -> DataFrame:
    return spatial.support(_local(spark, d), ["label"], "number", "family", RADIUS)


@query(
    f"""{_LOCAL}, x AS (SELECT a.label, a.vec_id // 80 AS pose FROM l a JOIN l b ON a.label = b.label AND a.vec_id % 2 = 1 AND b.vec_id % 2 = 0 WHERE sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) < 0.2)
SELECT label, pose, count(*) AS clashes FROM x GROUP BY label, pose HAVING count(*) >= 2"""
)
def local_clashes(spark: SparkSession, d: str) -> DataFrame:
    """Atoms are numbered anew in each pose."""
    rows = _points(spark, d).withColumn("pose", F.floor(F.col("vec_id") / 80))
    rows = rows.withColumn("atom", ranking.place(["label", "pose"], F.asc("vec_id")))
    return contacts.clashing(rows.where("vec_id % 2 = 1"), rows.where("vec_id % 2 = 0"), ["label"], "pose", "atom", 0.2, 2)


@query(None)
def running_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Centres move as points join in order: held against a plain loop in the tests."""
    return running.populated(running.first_match(_points(spark, d), ["label"], [F.asc("vec_id")], 0.1), ["label"], "family")


_KINDS = ("HOH", "MG", "K", "NA")


def _solvent(spark: SparkSession, d: str) -> DataFrame:
    """Points thirty times as far apart, each an atom of one of four kinds from one of seven donors."""
    rows = _points(spark, d).withColumns({a: F.col(a) * 30 for a in spatial.AXES})
    kind = F.element_at(F.array(*map(F.lit, _KINDS)), (F.col("vec_id") * 7 % 13 % 4 + 1).cast("int"))
    return rows.select("label", "vec_id", *spatial.AXES, kind.alias("kind"), (F.col("vec_id") % 7).alias("donor"))


@query(None)
def solvent_sites(spark: SparkSession, d: str) -> DataFrame:
    """Nearest sites, then merges until all contacts are kept: held against a plain loop in the tests."""
    matched = running.nearest_site(_solvent(spark, d), ["label"], "kind", [F.asc("donor"), F.asc("vec_id")])
    found = running.repaired(running.sites_of(matched, ["label"], "kind", "donor"), ["label"])
    return found.select("label", "site", *[F.round(a, 6).alias(a) for a in spatial.AXES], "n", "kind", F.size("donors").alias("support"))


@query(None)
def pooled_sites(spark: SparkSession, d: str) -> DataFrame:
    """Sites of two donors or more: held against a plain loop in the tests."""
    found = running.pooled(_solvent(spark, d), ["label"], "kind", "donor", [F.asc("vec_id")], 1.5, 2)
    return found.select("label", "site", "kind", "support", *[F.round(a, 6).alias(a) for a in spatial.AXES])


@query(None)
def solvent_budget(spark: SparkSession, d: str) -> DataFrame:
    """Exactly nine atoms of each label, core ones well apart first: held against a plain loop in the tests."""
    found = running.budget(_solvent(spark, d), ["label"], [F.asc("donor"), F.asc("vec_id")], "kind", F.col("vec_id") % 3 > 0, 9, 4.0)
    return found.select("label", "vec_id", "site", "pass")


_FAR = """v AS (SELECT label, vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
p AS (SELECT a.label, a.vec_id AS a, b.vec_id AS b, a.v AS va, b.v AS vb, list_distance(a.v, b.v) AS distance FROM v a JOIN v b ON a.label = b.label AND a.vec_id < b.vec_id),
f AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY label ORDER BY distance DESC, a, b) = 1)"""


@query(
    f"""WITH {_FAR}, s AS (SELECT v.label, vec_id, list_distance(v, va) > list_distance(v, vb) AS second, distance FROM v JOIN f USING (label)),
h AS (SELECT label, arg_min(second, vec_id) AS turned FROM s WHERE vec_id % 7 = 3 GROUP BY label)
SELECT label, vec_id, CASE WHEN second = coalesce(turned, false) THEN 1 ELSE 2 END AS side, round(distance, 9) AS apart FROM s LEFT JOIN h USING (label)"""
)
def two_conformations(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings").withColumn("primary", F.col("vec_id") % 7 == 3)
    return spread.split_by_farthest(rows, ["label"], "vec_id", "embedding", "primary").withColumn("apart", F.round("apart", 9))


def _picked(k: int) -> str:
    """One table per pick, each the row farthest from all before."""
    out = ["s1 AS (SELECT label, vec_id, v FROM m QUALIFY row_number() OVER (PARTITION BY label ORDER BY mean, vec_id) = 1)"]
    for n in range(2, k + 1):
        least = ", ".join(f"list_distance(v.v, s{i}.v)" for i in range(1, n))
        joins = " ".join(f"JOIN s{i} ON s{i}.label = v.label AND s{i}.vec_id <> v.vec_id" for i in range(1, n))
        out.append(f"s{n} AS (SELECT v.label, v.vec_id, v.v FROM v {joins} QUALIFY row_number() OVER (PARTITION BY v.label ORDER BY least({least}) DESC, v.vec_id) = 1)")
    return ", ".join(out)


@query(
    f"""WITH {_FAR}, m AS (SELECT a.label, a.vec_id, any_value(a.v) AS v, round(avg(list_distance(a.v, b.v)), 12) AS mean FROM v a JOIN v b ON a.label = b.label GROUP BY a.label, a.vec_id),
{_picked(4)}, x AS ({" UNION ALL ".join(f"SELECT label, {i} AS rank, vec_id, v FROM s{i}" for i in range(1, 5))})
SELECT x.label, x.rank, x.vec_id, round(min(list_distance(x.v, y.v)), 9) AS apart FROM x JOIN x y ON x.label = y.label AND x.rank <> y.rank GROUP BY x.label, x.rank, x.vec_id"""
)
def spread_templates(spark: SparkSession, d: str) -> DataFrame:
    found = spread.farthest_points(table(spark, d, "embeddings"), ["label"], "vec_id", "embedding", 4)
    return found.withColumn("apart", F.round("apart", 9))


@query(f"SELECT *, 1.0::DOUBLE AS turn FROM ({ORACLE_SQL['superposed_rmsd']})")
def superposed_frames(spark: SparkSession, d: str) -> DataFrame:
    """Points moved by the frames of their label: what is left is the least root mean square distance, and no frame mirrors."""
    names = [f"{side}{i}" for side in "pq" for i in range(3)]
    rows = table(spark, d, "embeddings").select("label", *[F.get("embedding", F.lit(i)).cast("double").alias(n) for i, n in enumerate(names)])
    frames = superposition.frames(rows, ["label"], names[:3], names[3:]).transform(lineage.settled)
    near = superposition.moved(rows, frames, ["label"], names[:3])
    square = sum((F.pow(F.col(f"p{i}") - F.col(f"q{i}"), F.lit(2)) for i in range(1, 3)), F.pow(F.col("p0") - F.col("q0"), F.lit(2)))
    left = near.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.round(F.sqrt(F.avg(square)), 6).alias("rmsd"))
    r = lambda i, j: F.col(f"r{i}{j}")
    turn = r(0, 0) * (r(1, 1) * r(2, 2) - r(1, 2) * r(2, 1)) - r(0, 1) * (r(1, 0) * r(2, 2) - r(1, 2) * r(2, 0)) + r(0, 2) * (r(1, 0) * r(2, 1) - r(1, 1) * r(2, 0))
    return left.join(frames.select("label", F.round(turn, 6).alias("turn")), "label")


# names of parts, their words joined; of every third part's name all but the last word is staged, of every fortieth all
_STAGED = """s AS (SELECT DISTINCT array_to_string(string_split(p_name, ' ')[1:-2], '_') AS stem FROM part WHERE p_partkey % 3 = 0 AND p_name LIKE '% %'
UNION SELECT replace(p_name, ' ', '_') FROM part WHERE p_partkey % 40 = 1)"""


@query(
    f"""WITH {_STAGED}, n AS (SELECT p_partkey, replace(p_name, ' ', '_') || '_' || p_size || '_' || p_partkey % 10 AS name FROM part),
c AS (SELECT p_partkey, name, stem, substr(name, length(stem) + 2) AS rest FROM n JOIN s ON name = stem OR starts_with(name, stem || '_')),
b AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY length(stem) DESC) = 1)
SELECT n.p_partkey, n.name, CASE WHEN stem IS NULL OR stem = n.name THEN n.name WHEN regexp_full_match(split_part(rest, '_', 1), '[0-9]+') THEN stem || '_' || split_part(rest, '_', 1) ELSE stem || '_0' END AS canonical
FROM n LEFT JOIN b USING (p_partkey)"""
)
def staged_names(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    words = F.split("p_name", " ")
    staged = part.where((F.col("p_partkey") % 3 == 0) & (F.size(words) > 1)).select(F.array_join(F.slice(words, 1, F.size(words) - 1), "_").alias("stem"))
    staged = staged.unionByName(part.where("p_partkey % 40 = 1").select(F.replace("p_name", F.lit(" "), F.lit("_")).alias("stem")))
    names = part.select("p_partkey", F.concat_ws("_", F.replace("p_name", F.lit(" "), F.lit("_")), F.col("p_size").cast("string"), (F.col("p_partkey") % 10).cast("string")).alias("name"))
    return assembly.canonical_names(names, staged, "name", "stem").select("p_partkey", "name", "canonical")


@query(
    f"""WITH RECURSIVE {_POINTS}, both_ways AS (SELECT a, b FROM n UNION ALL SELECT b, a FROM n),
reach(a, b) AS (SELECT vec_id, vec_id FROM e UNION SELECT r.a, w.b FROM reach r JOIN both_ways w ON r.b = w.a), c AS (SELECT a AS vec_id, min(b) AS cluster FROM reach GROUP BY a),
q AS (SELECT *, CASE WHEN vec_id % 5 > 0 THEN vec_id * 13 % 17 END AS resolution FROM c JOIN e USING (vec_id))
SELECT label, cluster, (count(*) OVER (PARTITION BY label, cluster)) AS size, vec_id FROM q QUALIFY row_number() OVER (PARTITION BY label, cluster ORDER BY resolution NULLS LAST, vec_id) = 1"""
)
def best_resolved(spark: SparkSession, d: str) -> DataFrame:
    """The member of best resolution of each cluster; every fifth one has none."""
    clustered = spatial.single_link(_points(spark, d), ["label"], "vec_id", RADIUS)
    return spatial.representatives(clustered, ["label"], "vec_id", F.when(F.col("vec_id") % 5 > 0, F.col("vec_id") * 13 % 17))


@query(
    """SELECT o_orderkey, count(l_orderkey) AS entries, count(*) FILTER (l_returnflag IN ('R', 'N')) AS kept,
coalesce(string_agg(CASE WHEN l_returnflag IN ('R', 'N') THEN l_partkey::VARCHAR END, ',' ORDER BY l_linenumber, l_partkey), '') AS parts
FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey"""
)
def typed_entries(spark: SparkSession, d: str) -> DataFrame:
    """All orders with their entries, of which those of two kinds are kept."""
    items = table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    rows = evidence.annotate(table(spark, d, "orders").select("o_orderkey"), items, ["o_orderkey"], ["l_linenumber", "l_partkey", "l_returnflag"], "entries")
    kept = F.filter("entries", lambda x: x["l_returnflag"].isin("R", "N"))
    parts = F.array_join(F.transform(kept, lambda x: x["l_partkey"].cast("string")), ",")
    return rows.select("o_orderkey", F.size("entries").cast("long").alias("entries"), F.size(kept).cast("long").alias("kept"), parts.alias("parts"))


@query("SELECT DISTINCT l_partkey, l_linestatus FROM lineitem WHERE l_returnflag = 'R'")
def distinct_candidates(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").where("l_returnflag = 'R'").select("l_partkey", "l_linestatus").distinct()


def _chains(spark: SparkSession, d: str) -> DataFrame:
    """Labels as structures of three chains, their points as residues."""
    rows = _points(spark, d).withColumn("chain", F.col("vec_id") % 3)
    return rows.withColumn("residue", ranking.place(["label", "chain"], F.asc("vec_id"))).select("label", "chain", "residue", *spatial.AXES)


@query(None)
def assembly_distances(spark: SparkSession, d: str) -> DataFrame:
    """Each structure against the next one: held against all permutations in the tests."""
    rows = _chains(spark, d)
    found = superposition.assemblies(rows, rows.withColumn("label", F.col("label") - 1), ["label"], "chain", "residue")
    return found.withColumn("rmsd", F.round("rmsd", 6))


@query(
    f"""WITH RECURSIVE {_POINTS}, both_ways AS (SELECT a, b FROM n UNION ALL SELECT b, a FROM n),
reach(a, b) AS (SELECT vec_id, vec_id FROM e UNION SELECT r.a, w.b FROM reach r JOIN both_ways w ON r.b = w.a), c AS (SELECT a AS vec_id, min(b) AS cluster FROM reach GROUP BY a),
s AS (SELECT label, cluster, count(*) AS size FROM c JOIN e USING (vec_id) GROUP BY label, cluster), r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY size DESC, cluster) AS pl FROM s)
SELECT label, sum(size)::BIGINT AS n, count(*) AS clusters, count(*) FILTER (size = 1) AS singletons, count(*) FILTER (size > 1) AS multiple,
string_agg(CASE WHEN pl <= 10 THEN size::VARCHAR END, ';' ORDER BY pl) AS largest, round(count(*) / sum(size), 6) AS reduction FROM r GROUP BY label"""
)
def cluster_statistics(spark: SparkSession, d: str) -> DataFrame:
    clustered = spatial.single_link(_points(spark, d), ["label"], "vec_id", RADIUS)
    return statistics.cluster_statistics(clustered, ["label"], "cluster")


@query(
    """SELECT CASE WHEN n_chars > 0 AND n_chars <= 100 THEN 0 WHEN n_chars > 100 AND n_chars <= 200 THEN 1 WHEN n_chars > 200 AND n_chars <= 1000 THEN 2 WHEN n_chars > 1000 AND n_chars <= 20000 THEN 3 END AS bin,
count(*) AS n, round(avg(n_chars), 6) AS mean, max(n_chars) AS most FROM documents GROUP BY 1"""
)
def pool_size_bins(spark: SparkSession, d: str) -> DataFrame:
    binned = table(spark, d, "documents").groupBy(statistics.right_bins(F.col("n_chars"), [0, 100, 200, 1000, 20000]).alias("bin"))
    return binned.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("n_chars"), 6).alias("mean"), F.max("n_chars").alias("most"))


@query(
    """WITH m AS (SELECT l_suppkey, median(l_discount * 20) AS a, median(CASE WHEN l_quantity >= 45 THEN l_tax * 20 END) AS b FROM lineitem GROUP BY l_suppkey),
x AS (SELECT *, round(coalesce((a + b) / 2, a, b), 6) AS ensemble FROM m)
SELECT l_suppkey, round(a, 6) AS median_a, round(b, 6) AS median_b, ensemble, round(pow(10, ensemble), 6) AS affinity FROM x"""
)
def ensemble_affinities(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").withColumns({"a": F.col("l_discount") * 20, "b": F.col("l_tax") * 20})
    return statistics.affinities(rows, ["l_suppkey"], "a", "b", F.col("l_quantity") >= 45)


@query(
    """SELECT c_nationkey, c_custkey FROM customer QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY sha256('42/' || c_custkey), c_custkey) <= 5"""
)
def audited_sample(spark: SparkSession, d: str) -> DataFrame:
    return statistics.seeded_sample(table(spark, d, "customer").select("c_nationkey", "c_custkey"), ["c_nationkey"], "c_custkey", 5, 42)


@query(
    r"""WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, '<a href="[^"]*">[^<]*<')) AS link, generate_subscripts(regexp_extract_all(html, '<a href="[^"]*">[^<]*<'), 1) AS nth FROM pages),
n AS (SELECT page_id, nth, upper(replace(regexp_extract(link, '<a href="([^"]*)">([^<]*)<', 2), 'ß', 'SS')) AS name, regexp_extract(link, '<a href="([^"]*)">([^<]*)<', 1) AS target FROM l)
SELECT page_id, name, target FROM n QUALIFY row_number() OVER (PARTITION BY page_id, name ORDER BY nth DESC) = 1"""
)
def named_links(spark: SparkSession, d: str) -> DataFrame:
    return files.named_links(table(spark, d, "pages"), "page_id", "html", '<a href="([^"]*)">([^<]*)<')
