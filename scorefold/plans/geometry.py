"""Queries on near points, superposed structures and selections that walk an order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import contacts, greedy, poses, ranking, screening, spatial, superposition
from ..sources.tables import table
from .catalogue import _POINTS, RADIUS, _points
from .registry import query

_SCORE = "(vec_id * 37 % 101)::DOUBLE"


def _apart(kept: str, row: str, near: str) -> str:
    """Members of the list ``kept`` that lie near ``row``."""
    return f"list_filter({kept}, lambda k: sqrt((k.x - {row}.x) ** 2 + (k.y - {row}.y) ** 2 + (k.z - {row}.z) ** 2) {near})"


def _walk(near: str, order: str, most: int = 1000000) -> str:
    """w: one row per point (label, i, vec_id) with the list of points kept up to it, walking each label in order."""
    return f"""o AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {order}) AS i FROM e),
w(label, i, vec_id, kept, took) AS (SELECT label, 0::BIGINT, NULL::BIGINT, []::STRUCT(id BIGINT, x DOUBLE, y DOUBLE, z DOUBLE)[], false FROM (SELECT DISTINCT label FROM o)
UNION ALL SELECT o.label, o.i, o.vec_id, CASE WHEN len(w.kept) < {most} AND len({_apart("w.kept", "o", near)}) = 0 THEN list_append(w.kept, {{'id': o.vec_id, 'x': o.x, 'y': o.y, 'z': o.z}}) ELSE w.kept END,
 len(w.kept) < {most} AND len({_apart("w.kept", "o", near)}) = 0 FROM w JOIN o ON o.label = w.label AND o.i = w.i + 1)"""


_SEEDED = f"s AS (SELECT o.*, {_apart('w.kept', 'o', '< 0.06')}[1].id AS seed FROM w JOIN o ON w.vec_id = o.vec_id)"


@query(f"WITH RECURSIVE {_POINTS}, {_walk('< 0.06', 'weight DESC, vec_id')} SELECT label, vec_id FROM w WHERE took")
def ordered_proximity(spark: SparkSession, d: str) -> DataFrame:
    """Anchors in order of their tier, each dropped if it's near one kept before."""
    seeded = greedy.seeds(_points(spark, d), ["label"], "vec_id", [-F.col("weight")], RADIUS)
    return seeded.where("seed = vec_id").select("label", "vec_id")


@query(
    f"""WITH RECURSIVE {_POINTS}, {_walk('< 0.06', 'vec_id')}, {_SEEDED},
u AS (SELECT label, seed, unnest([x, y, z]) AS c FROM s), v AS (SELECT label, seed, stddev_pop(c) AS spread FROM u GROUP BY label, seed)
SELECT label, seed, count(*) AS size, round(avg(x), 6) AS centre_x, round(avg(y), 6) AS centre_y, round(avg(z), 6) AS centre_z, round(any_value(spread), 6) AS spread FROM s JOIN v USING (label, seed) GROUP BY label, seed"""
)
def seed_clusters(spark: SparkSession, d: str) -> DataFrame:
    return greedy.seed_clusters(greedy.seeds(_points(spark, d), ["label"], "vec_id", [], RADIUS), ["label"])


@query(
    f"""WITH RECURSIVE {_POINTS}, {_walk('< 0.06', f'{_SCORE} DESC, vec_id')}, {_SEEDED},
c AS (SELECT label, seed, count(*) AS size, max({_SCORE}) AS best FROM s GROUP BY label, seed)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY best DESC, seed) AS rank FROM c) WHERE rank <= 5"""
)
def confident_clusters(spark: SparkSession, d: str) -> DataFrame:
    """The five clusters with the most confident seeds."""
    rows = _points(spark, d).withColumn("score", (F.col("vec_id") * 37 % 101).cast("double"))
    found = greedy.seeds(rows, ["label"], "vec_id", [-F.col("score")], RADIUS).groupBy("label", "seed").agg(F.count(F.lit(1)).alias("size"), F.max("score").alias("best"))
    return found.withColumn("rank", ranking.place(["label"], F.desc("best"), F.asc("seed"))).where("rank <= 5")


_OWN = f"CASE WHEN label <> 3 AND vec_id % 11 <> 0 THEN {_SCORE} / 100 END"


@query(
    f"""WITH RECURSIVE {_POINTS.replace("e AS (", "raw AS (").replace("FROM e a JOIN e b", "FROM raw a JOIN raw b")},
p AS (SELECT *, {_OWN} AS score, nullif(weight, 1) AS tie FROM raw),
t AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS pl FROM p WHERE score IS NOT NULL),
e AS (SELECT * FROM t WHERE pl <= 20), {_walk('< 0.06', 'score + CASE WHEN family = 3 THEN 0.1 ELSE 0 END DESC, coalesce(tie, 0) DESC, vec_id', 4)}
SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY i) AS rank FROM w WHERE took
UNION ALL SELECT * FROM (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY tie DESC NULLS LAST, vec_id) AS rank FROM p WHERE label = 3 AND tie IS NOT NULL) WHERE rank <= 4"""
)
def cascaded_diverse_selection(spark: SparkSession, d: str) -> DataFrame:
    """Label 3 has no score and falls back on its ties."""
    score = F.when((F.col("label") != 3) & (F.col("vec_id") % 11 != 0), (F.col("vec_id") * 37 % 101).cast("double") / 100)
    rows = _points(spark, d).withColumns({"score": score, "tie": F.nullif(F.col("weight"), F.lit(1.0)), "point": F.array(*spatial.AXES)})
    return greedy.cascaded_top_k(rows, ["label"], "score", "tie", F.col("family") == 3, "tie", "point", "vec_id", k=4, pool=20, distance=RADIUS)


@query(
    f"""WITH RECURSIVE {_POINTS}, {_walk('< 0.06', f'{_SCORE} DESC, vec_id', 5)}
SELECT label, vec_id, {_SCORE} AS score, row_number() OVER (PARTITION BY label ORDER BY i) AS rank FROM w WHERE took"""
)
def diverse_selection(spark: SparkSession, d: str) -> DataFrame:
    rows = _points(spark, d).withColumn("score", (F.col("vec_id") * 37 % 101).cast("double")).withColumn("point", F.array(*spatial.AXES))
    return ranking.diverse_top_k(rows, ["label"], "score", "point", "vec_id", distance=RADIUS)


def _slots() -> str:
    """One table per slot, each of which avoids the picks before it."""
    out, before = [], []
    for i, share in enumerate((0.0, 0.25, 0.5, 0.75, 1.0)):
        used = " OR ".join(f"p_partkey IN (SELECT p_partkey FROM s{j})" for j in before) or "false"
        out.append(
            f"s{i} AS (SELECT p_brand, 'q{round(share * 100)}' AS slot, p_partkey FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY ({used}), round(abs(p_size - q[{i + 1}]), 9), p_partkey) AS pl FROM c) WHERE pl = 1)"
        )
        before.append(i)
    return ", ".join(out)


@query(
    f"""WITH q AS (SELECT p_brand, quantile_cont(p_size, [0, 0.25, 0.5, 0.75, 1]) AS q FROM part GROUP BY p_brand), c AS (SELECT * FROM part JOIN q USING (p_brand)), {_slots()}
SELECT * FROM s0 UNION ALL SELECT * FROM s1 UNION ALL SELECT * FROM s2 UNION ALL SELECT * FROM s3 UNION ALL SELECT * FROM s4"""
)
def quantile_representatives(spark: SparkSession, d: str) -> DataFrame:
    slots = {f"q{round(share * 100)}": share for share in (0.0, 0.25, 0.5, 0.75, 1.0)}
    return greedy.quantile_picks(table(spark, d, "part"), ["p_brand"], "p_size", "p_partkey", slots)


# odd points are ligand atoms, fours a pose; even ones the receptor
_SIDES = f"{_POINTS}, x AS (SELECT a.label, a.vec_id AS a, b.vec_id AS b, b.family AS chain, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) AS distance FROM e a JOIN e b ON a.label = b.label AND a.vec_id % 2 = 1 AND b.vec_id % 2 = 0)"


def _sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = _points(spark, d).withColumn("pose", F.floor(F.col("vec_id") / 8))
    return rows.where("vec_id % 2 = 1"), rows.where("vec_id % 2 = 0")


@query(f"WITH {_SIDES} SELECT label, a AS vec_id FROM x GROUP BY label, a HAVING min(distance) <= 0.1")
def surface_margin(spark: SparkSession, d: str) -> DataFrame:
    ligands, receptor = _sides(spark, d)
    return contacts.near_surface(ligands, receptor, ["label"], "vec_id", 0.1).select("label", "vec_id")


@query(f"WITH {_SIDES} SELECT label, a // 8 AS pose, count(*) AS clashes FROM x WHERE distance < 0.2 GROUP BY label, a // 8 HAVING count(*) >= 5")
def clash_gate(spark: SparkSession, d: str) -> DataFrame:
    ligands, receptor = _sides(spark, d)
    return contacts.clashing(ligands, receptor, ["label"], "pose", "vec_id", 0.2, 5)


@query(f"WITH {_SIDES}, bad AS (SELECT DISTINCT label, a // 8 AS pose FROM x WHERE distance < 0.1 AND b % 10 = 0) SELECT label, vec_id FROM e WHERE vec_id % 2 = 1 AND NOT EXISTS (SELECT 1 FROM bad WHERE bad.label = e.label AND pose = vec_id // 8)")
def cofactor_overlap(spark: SparkSession, d: str) -> DataFrame:
    ligands, receptor = _sides(spark, d)
    return contacts.without_overlaps(ligands, receptor.where("vec_id % 10 = 0"), ["label"], "pose", "vec_id", 0.1).select("label", "vec_id")


@query(
    f"""WITH {_SIDES}, c AS (SELECT a, chain, count(*) AS n FROM x WHERE distance <= 0.1 GROUP BY a, chain), h AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY n DESC, chain) AS pl FROM c) WHERE pl = 1)
SELECT label, vec_id, coalesce(chain, family) AS host, coalesce(n, 0) AS contacts FROM e LEFT JOIN h ON a = vec_id WHERE vec_id % 2 = 1"""
)
def host_chains(spark: SparkSession, d: str) -> DataFrame:
    ligands, receptor = _sides(spark, d)
    return contacts.host_chains(ligands, receptor, ["label"], "vec_id", "family", 0.1)


# label 0 has no pocket on its template's own chain
_CHAINS = "CASE WHEN label = 0 THEN 'a' WHEN vec_id % 5 > 0 THEN chr((97 + vec_id % 3)::INT) END"
_LIGAND = "CASE WHEN label = 0 THEN 'B' WHEN vec_id % 7 > 0 THEN ' ' || chr((65 + vec_id % 2)::INT) END"


@query(
    f"""WITH {_POINTS}, p AS (SELECT *, upper(trim(coalesce({_CHAINS}, ''))) AS t, upper(trim(coalesce({_LIGAND}, ''))) AS o FROM e),
k AS (SELECT *, NOT (t <> '' AND o <> '' AND t <> o) AS own FROM p),
m AS (SELECT *, bool_or(own) OVER (PARTITION BY label) AS any_own, row_number() OVER (PARTITION BY label, family, t, round_even(x * 10, 0), round_even(y * 10, 0), round_even(z * 10, 0), own ORDER BY vec_id) AS pl FROM k)
SELECT label, vec_id FROM m WHERE (own AND pl = 1) OR NOT any_own"""
)
def own_protomers(spark: SparkSession, d: str) -> DataFrame:
    letter = lambda first, n: F.char(first + F.col("vec_id") % n)
    t = F.when(F.col("label") == 0, "a").when(F.col("vec_id") % 5 > 0, letter(97, 3))
    o = F.when(F.col("label") == 0, "B").when(F.col("vec_id") % 7 > 0, F.concat(F.lit(" "), letter(65, 2)))
    rows = _points(spark, d).withColumns({"t": t, "o": o})
    return contacts.own_protomers(rows, ["label"], "t", "o", ["family"], "vec_id").select("label", "vec_id")


@query(f"WITH {_SIDES} SELECT label, a AS vec_id, count(*) AS near FROM x WHERE distance <= 0.15 GROUP BY label, a HAVING count(*) >= 3")
def corroborated_anchors(spark: SparkSession, d: str) -> DataFrame:
    entries, pockets = _sides(spark, d)
    return contacts.corroborated(entries, pockets, ["label"], "vec_id", 0.15, 3).select("label", "vec_id", "near")


@query(
    f"""WITH {_POINTS}, t AS (SELECT label, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM e WHERE label < 4 AND family = 0 GROUP BY label), r AS (SELECT label, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM e WHERE label < 6 AND family = 1 GROUP BY label),
both_ways AS (SELECT label, a AS v, b AS n FROM n UNION ALL SELECT label, b, a FROM n UNION ALL SELECT label, vec_id, vec_id FROM e), c AS (SELECT label, v, count(*) AS c FROM both_ways GROUP BY label, v),
m AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY c DESC, v) AS pl FROM c) WHERE pl = 1),
f AS (SELECT m.label, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM m JOIN both_ways b ON b.label = m.label AND b.v = m.v JOIN e ON e.vec_id = b.n WHERE m.label >= 6 GROUP BY m.label),
u AS (SELECT 'template' AS kind, * FROM t UNION ALL SELECT 'research', * FROM r UNION ALL SELECT 'density', * FROM f) SELECT kind, label, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z FROM u"""
)
def anchor_fallback(spark: SparkSession, d: str) -> DataFrame:
    rows = _points(spark, d)
    return poses.anchors(rows.where("label < 4 AND family = 0"), rows.where("label < 6 AND family = 1"), spatial.density_mode(rows, ["label"], "vec_id", RADIUS), ["label"])


_D = "(power - 2 * (sqrt(greatest(high, 0)) + sqrt(greatest(3 * mid - high - low, 0)) + side * sqrt(greatest(low, 0))))"


@query(
    """WITH e AS (SELECT label, embedding[1]::DOUBLE AS p0, embedding[2]::DOUBLE AS p1, embedding[3]::DOUBLE AS p2, embedding[4]::DOUBLE AS q0, embedding[5]::DOUBLE AS q1, embedding[6]::DOUBLE AS q2 FROM embeddings),
s AS (SELECT label, count(*) AS n, var_pop(p0) + var_pop(p1) + var_pop(p2) + var_pop(q0) + var_pop(q1) + var_pop(q2) AS power,"""
    + ", ".join(f"covar_pop(p{i}, q{j}) AS h{i}{j}" for i in range(3) for j in range(3))
    + " FROM e GROUP BY label), m AS (SELECT *, "
    + ", ".join(f"h0{i} * h0{j} + h1{i} * h1{j} + h2{i} * h2{j} AS m{i}{j}" for i in range(3) for j in range(i, 3))
    + f""", CASE WHEN h00 * (h11 * h22 - h12 * h21) - h01 * (h10 * h22 - h12 * h20) + h02 * (h10 * h21 - h11 * h20) < 0 THEN -1 ELSE 1 END AS side FROM s),
c AS (SELECT *, (m00 + m11 + m22) / 3 AS mid FROM m), w AS (SELECT *, sqrt(((m00 - mid) ** 2 + (m11 - mid) ** 2 + (m22 - mid) ** 2 + 2 * (m01 ** 2 + m02 ** 2 + m12 ** 2)) / 6) AS wide FROM c),
t AS (SELECT *, acos(greatest(-1, least(1, ((m00 - mid) * ((m11 - mid) * (m22 - mid) - m12 * m12) - m01 * (m01 * (m22 - mid) - m12 * m02) + m02 * (m01 * m12 - (m11 - mid) * m02)) / (2 * wide ** 3)))) / 3 AS angle FROM w),
r AS (SELECT *, mid + 2 * wide * cos(angle) AS high, mid + 2 * wide * cos(angle + 2 * pi() / 3) AS low FROM t)
SELECT label, n, round(sqrt(greatest({_D}, 0)), 6) AS rmsd FROM r"""
)
def superposed_rmsd(spark: SparkSession, d: str) -> DataFrame:
    names = [f"{side}{i}" for side in "pq" for i in range(3)]
    rows = table(spark, d, "embeddings").select("label", *[F.get("embedding", F.lit(i)).cast("double").alias(n) for i, n in enumerate(names)])
    return superposition.superposed_rmsd(rows, ["label"], names[:3], names[3:])


@query(
    """WITH f AS (SELECT *, row_number() OVER (PARTITION BY l_shipmode, l_returnflag, l_partkey ORDER BY l_orderkey, l_linenumber, l_quantity) AS pl FROM (SELECT *, l_linestatus AS l_shipmode FROM lineitem)),
p AS (SELECT * FROM f WHERE pl = 1 AND l_returnflag = 'R'), r AS (SELECT * FROM f WHERE pl = 1 AND l_returnflag = 'N'),
j AS (SELECT p.l_shipmode AS chain, count(*) AS n, round(sqrt(avg((p.l_quantity - r.l_quantity) ** 2 + (p.l_discount - r.l_discount) ** 2 + (p.l_tax - r.l_tax) ** 2)), 6) AS rmsd FROM p JOIN r ON p.l_shipmode = r.l_shipmode AND p.l_partkey = r.l_partkey GROUP BY p.l_shipmode)
SELECT chain, coalesce(n, 0) AS n, rmsd FROM (SELECT DISTINCT l_shipmode AS chain FROM p) LEFT JOIN j USING (chain)"""
)
def positional_rmsd(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").withColumn("chain", F.col("l_linestatus"))
    order = [F.asc(c) for c in ("l_orderkey", "l_linenumber", "l_quantity")]
    sides = [rows.where(F.col("l_returnflag") == flag) for flag in "RN"]
    return superposition.positional_rmsd(*sides, ["chain"], ["l_partkey"], order, ["l_quantity", "l_discount", "l_tax"])


_OFFSETS = """a AS (SELECT p_partkey, p_name AS r, p_type AS p FROM part WHERE p_name <> '' AND p_type <> ''),
o AS (SELECT p_partkey, r, p, unnest(range(1 - len(r), len(p)))::BIGINT AS o FROM a), i AS (SELECT *, unnest(range(0, len(r)))::BIGINT AS i FROM o),
c AS (SELECT p_partkey, o, count(*) FILTER (i + o >= 0 AND i + o < len(p) AND r[i + 1] = p[i + o + 1]) AS n FROM i GROUP BY p_partkey, o),
m AS (SELECT p_partkey, CASE WHEN n > 0 THEN o ELSE 0 END AS shift, n AS matches FROM (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY n DESC, o) AS pl FROM c) WHERE pl = 1)"""


def _offsets(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").select("p_partkey", F.upper("p_name").alias("r"), F.col("p_type").alias("p"))
    return superposition.offsets(rows, ["p_partkey"], "r", "p")


@query(f"WITH {_OFFSETS.replace('p_name AS r', 'upper(p_name) AS r')} SELECT p.p_partkey, coalesce(shift, 0) AS shift, coalesce(matches, 0) AS matches FROM part p LEFT JOIN m USING (p_partkey)")
def sequence_offsets(spark: SparkSession, d: str) -> DataFrame:
    return _offsets(spark, d).select("p_partkey", F.col("offset").cast("bigint").alias("shift"), F.col("matches").cast("bigint").alias("matches"))


@query(
    f"""WITH {_OFFSETS.replace('p_name AS r', 'upper(p_name) AS r')}, k AS (SELECT *, unnest(range(0, len(r)))::BIGINT AS i FROM a JOIN m USING (p_partkey))
SELECT p_partkey, i, i + shift AS j, r[i + 1] AS letter FROM k WHERE i + shift >= 0 AND i + shift < len(p) AND r[i + 1] = p[i + shift + 1]"""
)
def sequence_pairs(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").select("p_partkey", F.upper("p_name").alias("r"), F.col("p_type").alias("p"))
    rows = rows.join(_offsets(spark, d).select("p_partkey", F.col("offset").alias("by")), "p_partkey")
    left, right = rows.select("p_partkey", F.col("r").alias("s"), "by"), rows.select("p_partkey", F.col("p").alias("s"))
    return superposition.matched_pairs(left, right, ["p_partkey"], "s", F.col("by"))


@query(None)
def random_baseline(spark: SparkSession, d: str) -> DataFrame:
    """Random draws: held against a plain loop in the tests."""
    sizes = table(spark, d, "part").groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("p_size") > 40).alias("hits"))
    return screening.random_bedroc(sizes, "p_brand", "n", "hits")
