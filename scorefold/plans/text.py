"""Queries that take names and texts apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import naming, parsing
from ..sources.tables import table
from .registry import query

PREFIXES = [
    "cofold_boltz2x_", "cofold_boltz2_", "cofold_af3_", "vina_cofolding_", "vina_template_consensus_", "autodock_gpu_cofolding_", "template_8bua_vina_", "template_8bua_lig_align_",
    "template_1abc_adg_", "protenix_dock_", "", "template_9xyz_autodock_gpu_", "vina_swinsite_",
]
# a part's name with a tool before it, and a ligand, a seed or sample and an index after it as its size has them
_N = f"""n AS (SELECT p_partkey, {PREFIXES}[p_partkey % {len(PREFIXES)} + 1] || replace(p_name, ' ', '_') || CASE p_size % 4 WHEN 0 THEN '_L' WHEN 1 THEN '_X12' WHEN 2 THEN '_3_L' ELSE '' END
 || CASE p_size % 3 WHEN 0 THEN '_seed_' || p_size WHEN 1 THEN '_sample-' || p_size ELSE '' END || CASE WHEN p_partkey % 2 = 0 THEN '_' || p_size % 10 ELSE '' END AS name FROM part)"""


def _joined(name: str = "p_name") -> Column:
    return F.replace(name, F.lit(" "), F.lit("_"))


def _named(spark: SparkSession, d: str) -> DataFrame:
    size = F.col("p_size")
    tool = F.element_at(F.array(*map(F.lit, PREFIXES)), (F.col("p_partkey") % len(PREFIXES) + 1).cast("int"))
    ligand = F.element_at(F.array(*map(F.lit, ["_L", "_X12", "_3_L", ""])), (size % 4 + 1).cast("int"))
    run = F.when(size % 3 == 0, F.concat(F.lit("_seed_"), size)).when(size % 3 == 1, F.concat(F.lit("_sample-"), size)).otherwise("")
    at = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("_"), size % 10)).otherwise("")
    return table(spark, d, "part").select("p_partkey", F.concat(tool, _joined(), ligand, run, at).alias("name"))


_FAMILY = (
    "CASE " + " ".join(f"WHEN starts_with(name, '{p}') THEN '{f}'" for p, f in naming.FAMILIES.items())
    + " ".join(f" WHEN contains(name, 'template_') AND contains(name, '{p}') THEN '{f}'" for p, f in naming.TEMPLATE_FAMILIES.items()) + " ELSE name END"
)


@query(
    rf"""WITH {_N}, g AS (SELECT *, regexp_replace(name, '(_seed_\d+)?_\d+$', '') AS g FROM n)
SELECT p_partkey, {_FAMILY} AS family, regexp_replace(regexp_replace(name, '_(L\d*|X\d*)$', ''), '_seed[_-]\d+.*', '') AS report_family, g AS pose_group,
CASE WHEN starts_with(g, 'cofold_') THEN 0 WHEN contains(g, 'template_consensus') THEN 1 WHEN starts_with(g, 'template_') AND (contains(g, '_vina') OR contains(g, '_adg')) THEN 2 ELSE 3 END AS track,
CASE WHEN regexp_matches(lower(name), '^autodock_gpu|_adg_|_adg_l$') THEN 'dlg' WHEN regexp_matches(lower(name), '^vina|_vina_|_vina_l$') THEN 'vina_embedded'
 WHEN starts_with(lower(name), 'cofold') THEN 'cofold' ELSE 'other' END AS dock_kind FROM g"""
)
def source_families(spark: SparkSession, d: str) -> DataFrame:
    group = naming.pose_group(F.col("name"))
    return _named(spark, d).select(
        "p_partkey", naming.source_family(F.col("name")).alias("family"), naming.report_family(F.col("name")).alias("report_family"), group.alias("pose_group"),
        naming.track(group).alias("track"), naming.dock_kind(F.col("name")).alias("dock_kind"),
    )


@query(
    rf"""WITH {_N}, b AS (SELECT p_partkey, CASE WHEN name LIKE '%\_L' ESCAPE '\' THEN left(name, length(name) - 2) ELSE name END AS b FROM n),
t AS (SELECT *, nullif(regexp_extract(b, '^template_([^_]+)_(.+)$', 1), '') AS pdb, nullif(regexp_extract(b, '^template_([^_]+)_(.+)$', 2), '') AS m FROM b)
SELECT p_partkey, CASE WHEN starts_with(b, 'cofold_') THEN b WHEN starts_with(b, 'template_') THEN CASE WHEN m IN ('autodock_gpu', 'adg') THEN 'template_adg' WHEN m IS NULL THEN 'template_unknown' ELSE 'template_' || m END
 WHEN starts_with(b, 'vina_') THEN 'vina' WHEN starts_with(b, 'autodock_gpu_') THEN 'adg' WHEN starts_with(b, 'protenix_dock') THEN 'pxdock' ELSE b END AS family,
CASE WHEN starts_with(b, 'vina_') THEN substr(b, 6) WHEN starts_with(b, 'autodock_gpu_') THEN substr(b, 14) END AS box_source, pdb AS template,
CASE WHEN starts_with(b, 'cofold_') THEN 0 WHEN m = 'lig_align' THEN 3 WHEN starts_with(b, 'template_') THEN 2 ELSE 1 END AS track FROM t"""
)
def source_parts(spark: SparkSession, d: str) -> DataFrame:
    return _named(spark, d).select("p_partkey", naming.source_parts(F.col("name"), F.lit("L")).alias("p")).select("p_partkey", "p.*")


@query(
    rf"""WITH {_N} SELECT p_partkey, TRY_CAST(nullif(regexp_extract(name, '_seed[_-](\d+)', 1), '') AS INTEGER) AS seed, TRY_CAST(nullif(regexp_extract(name, 'sample[_-](\d+)', 1), '') AS INTEGER) AS sample,
TRY_CAST(nullif(regexp_extract(name, '_(\d+)$', 1), '') AS INTEGER) AS idx, coalesce(nullif(regexp_extract(name, '^(.*)_(\d+)$', 1), ''), name) AS stem,
CASE WHEN regexp_matches(name, '_seed_\d+$') THEN regexp_extract(name, '^(.*)_seed_\d+$', 1) ELSE name END AS source, TRY_CAST(nullif(regexp_extract(name, '^.*_seed_(\d+)$', 1), '') AS INTEGER) AS source_seed FROM n"""
)
def pose_names(spark: SparkSession, d: str) -> DataFrame:
    name = F.col("name")
    source, seed = naming.source_and_seed(name)
    return _named(spark, d).select(
        "p_partkey", parsing.seed(name).alias("seed"), naming.sample(name).alias("sample"), parsing.trailing_index(name).alias("idx"), naming.stem(name).alias("stem"),
        source.alias("source"), seed.alias("source_seed"),
    )


@query(f"WITH {_N} SELECT p_partkey, CASE WHEN name LIKE '%\\_3\\_L' ESCAPE '\\' THEN '3_L' WHEN name LIKE '%\\_X12' ESCAPE '\\' THEN 'X12' WHEN name LIKE '%\\_L' ESCAPE '\\' THEN 'L' END AS ligand FROM n")
def ligand_ids(spark: SparkSession, d: str) -> DataFrame:
    return _named(spark, d).select("p_partkey", naming.ligand_of(F.col("name"), ["L", "X12", "3_L"]).alias("ligand"))


# addresses of pages: as they are, as entry and chain, with an index twice, as inputs
_K = """n AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN url WHEN 1 THEN upper(replace(replace(url, ':', ''), '/', '_')) WHEN 2 THEN replace(url, '/', '_') || '_' || page_id % 7 || '_' || page_id % 3
 ELSE replace(url, '.', '_') || '_input' END AS name FROM pages)"""


@query(
    rf"""WITH {_K} SELECT page_id, CASE WHEN contains(name, '_') THEN lower(split_part(name, '_', 1)) ELSE lower(left(name, 4)) END AS entry,
CASE WHEN contains(name, '_') THEN split_part(name, '_', 2) ELSE '' END AS chain,
CASE WHEN regexp_matches(name, '_\d+_\d+$') AND regexp_extract(name, '_(\d+)_(\d+)$', 1) = regexp_extract(name, '_(\d+)_(\d+)$', 2) THEN regexp_replace(name, '_\d+$', '') ELSE name END AS once,
regexp_replace(name, '_input$', '') AS target, coalesce(nullif(regexp_replace(regexp_replace(name, '[^a-zA-Z0-9._-]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'job') AS job FROM n"""
)
def target_keys(spark: SparkSession, d: str) -> DataFrame:
    url, at = F.col("url"), F.col("page_id")
    entry = F.upper(F.replace(F.replace(url, F.lit(":"), F.lit("")), F.lit("/"), F.lit("_")))
    twice = F.concat_ws("_", F.replace(url, F.lit("/"), F.lit("_")), (at % 7).cast("string"), (at % 3).cast("string"))
    name = F.when(at % 4 == 0, url).when(at % 4 == 1, entry).when(at % 4 == 2, twice).otherwise(F.concat(F.replace(url, F.lit("."), F.lit("_")), F.lit("_input")))
    rows = table(spark, d, "pages").select("page_id", name.alias("name"))
    entry, chain = parsing.key_parts(F.col("name"))
    return rows.select(
        "page_id", entry.alias("entry"), chain.alias("chain"), parsing.once_indexed(F.col("name")).alias("once"),
        F.regexp_replace("name", "_input$", "").alias("target"), naming.job_name(F.col("name")).alias("job"),
    )


# one or three letters of a part's name or type and its size
_T = "n AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN left(p_name, 3) WHEN 1 THEN left(p_name, 1) ELSE left(p_type, 3) END || p_size AS name FROM part)"
_RESIDUE = "CASE WHEN left(u, 3) IN ({}) THEN left(u, 3) {} END".format(", ".join(f"'{x}'" for x in naming.RESIDUES.values()), " ".join(f"WHEN u = '{a}' THEN '{b}'" for a, b in naming.RESIDUES.items()))


@query(
    rf"""WITH {_T}, t AS (SELECT p_partkey, upper(regexp_extract(name, '^([A-Za-z]*)(\d+)$', 1)) AS u,
 TRY_CAST(nullif(regexp_extract(name, '^([A-Za-z]*)(\d+)$', 2), '') AS INTEGER) AS number FROM n) SELECT p_partkey, {_RESIDUE} AS residue, number FROM t"""
)
def residue_tokens(spark: SparkSession, d: str) -> DataFrame:
    at = F.col("p_partkey") % 3
    head = F.when(at == 0, F.substring("p_name", 1, 3)).when(at == 1, F.substring("p_name", 1, 1)).otherwise(F.substring("p_type", 1, 3))
    name, number = naming.residue(F.concat(head, F.col("p_size")))
    return table(spark, d, "part").select("p_partkey", name.alias("residue"), number.alias("number"))


@query(
    """WITH n AS (SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN '' ELSE p_size || ':' || upper(left(p_name, 3)) || ' , ,' || p_partkey % 100 || ': ' || upper(left(p_type, 3)) END AS spec FROM part),
e AS (SELECT p_partkey, trim(unnest(string_split(spec, ','))) AS e FROM n)
SELECT p_partkey, CAST(split_part(e, ':', 1) AS INTEGER) AS position, trim(split_part(e, ':', 2)) AS code FROM e WHERE e <> ''"""
)
def modification_lists(spark: SparkSession, d: str) -> DataFrame:
    code = lambda c: F.upper(F.substring(c, 1, 3))
    spec = F.concat(F.col("p_size"), F.lit(":"), code("p_name"), F.lit(" , ,"), F.col("p_partkey") % 100, F.lit(": "), code("p_type"))
    return table(spark, d, "part").select("p_partkey", F.inline(naming.modifications(F.when(F.col("p_size") % 5 == 0, "").otherwise(spec))))


@query(
    """SELECT p_partkey, round(p_size + 0.65 * nullif(p_retailprice, 1000.5), 6) AS full_score, round(p_retailprice / nullif(p_size - 10, 0), 6) AS efficiency,
CASE WHEN p_size % 3 = 0 THEN 0 ELSE 1 END + greatest(0.0, coalesce(nullif(p_size, 7) / 50.0, 0), p_retailprice / 100000) + greatest(0.0, coalesce(nullif(p_size, 8) / 60.0, 0)) AS evidence,
lpad(CAST(CASE WHEN p_partkey <= 356 THEN p_partkey WHEN p_partkey = 357 THEN 356 ELSE p_partkey - 1 END AS VARCHAR), 6, '0') AS run, round(pow(10, p_size / 25.0 + 3), 3) AS affinity,
coalesce(TRY_CAST(CASE WHEN p_size % 2 = 0 THEN 'x' ELSE CAST(p_size AS VARCHAR) END AS DOUBLE), 0) AS number, p_size % 4 IN (1, 2) AS flag FROM part"""
)
def derived_scores(spark: SparkSession, d: str) -> DataFrame:
    size, price = F.col("p_size"), F.col("p_retailprice")
    weight = naming.evidence_weight(F.when(size % 3 == 0, 0).otherwise(1), [F.nullif(size, F.lit(7)) / 50, price / 100000], [F.nullif(size, F.lit(8)) / 60])
    said = F.element_at(F.array(*map(F.lit, ["no", "Yes", " TRUE", ""])), (size % 4 + 1).cast("int"))
    return table(spark, d, "part").select(
        "p_partkey", F.round(size + 0.65 * F.expr("nullif(p_retailprice, 1000.5D)"), 6).alias("full_score"), F.round(F.try_divide(price, size - 10), 6).alias("efficiency"), weight.alias("evidence"),
        naming.shifted_id(F.col("p_partkey")).alias("run"), F.round(F.pow(F.lit(10.0), size / 25 + 3), 3).alias("affinity"),
        F.coalesce(parsing.number(F.when(size % 2 == 0, "x").otherwise(size.cast("string"))), F.lit(0.0)).alias("number"), naming.flag(said).alias("flag"),
    )


_LABELS = {kind: "CASE " + " ".join(f"WHEN starts_with(name, '{p}') THEN '{f}'" for p, f in starts.items()) + " " + " ".join(f"WHEN contains(name, 'template_') AND contains(name, '{p}') THEN '{f}'" for p, f in inside.items()) + " ELSE name END" for kind, (starts, inside) in naming.REPORTS.items()}


@query(
    f"""WITH {_N} SELECT p_partkey, {_LABELS["score"]} AS by_score, {_LABELS["consensus"]} AS by_consensus,
CASE WHEN regexp_matches(name, '^cofold_(boltz2x|boltz2|protenix|af3)') THEN regexp_extract(name, '^cofold_(boltz2x|boltz2|protenix|af3)') ELSE split_part(name, '_seed', 1) END AS ablated FROM n"""
)
def report_families(spark: SparkSession, d: str) -> DataFrame:
    name = F.col("name")
    return _named(spark, d).select("p_partkey", naming.report_label(name, "score").alias("by_score"), naming.report_label(name, "consensus").alias("by_consensus"), naming.ablation_family(name).alias("ablated"))
