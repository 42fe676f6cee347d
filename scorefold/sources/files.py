"""Typed scans of the smaller text files: model hits, filtered hits, labels, submissions, clusters, components and pockets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.parsing import key_parts, number, once_indexed
from .records import lines_of, numbered
from .tables import headerless

MODEL_HITS = {"target": 1, "pident": 2, "evalue": 10, "lddt": 14, "tmscore": 15}


def model_hits(spark: SparkSession, path: str) -> DataFrame:
    """Hits of a structure search with 14 to 16 columns; shorter rows are skipped, absent lddt and tmscore are 0."""
    rows = headerless(spark, path, [f"c{i}" for i in range(16)], 14)
    named = rows.select(*[F.col(f"c{i}").alias(n) for n, i in MODEL_HITS.items()])
    entry, chain = key_parts(F.col("target"))
    scores = {n: F.coalesce(number(F.col(n)), F.lit(0.0)) for n in ("lddt", "tmscore")} | {n: number(F.col(n)) for n in ("pident", "evalue")}
    return named.withColumns(scores).withColumns({"entry": entry, "chain": chain})


def named_or_raw_hits(spark: SparkSession, path: str) -> DataFrame:
    """entry, target and pident (text) of a file with a header that begins with ``query``, else of raw rows by position."""
    first = spark.read.text(path).limit(1).collect()  # the header, if there is one
    if first and first[0].value.startswith("query\t"):
        rows = spark.read.csv(path, sep="\t", header=True)
        return rows.select(F.col("pdb_id").alias("entry") if "pdb_id" in rows.columns else key_parts(F.col("target"))[0].alias("entry"), "target", "pident")
    raw = headerless(spark, path, ["query", "target", "pident"], 12)
    return raw.select(key_parts(F.col("target"))[0].alias("entry"), "target", "pident")


def hits_with_ligands(spark: SparkSession, path: str) -> DataFrame:
    """Filtered hits with at least one ligand; rows whose count is no number are skipped."""
    rows = spark.read.csv(path, sep="\t", header=True)
    return rows.withColumn("num_ligands", F.col("num_ligands").try_cast("int")).where("num_ligands > 0")


def truth(spark: SparkSession, path: str, key: str, label: str = "binding") -> DataFrame:
    """(key, binds) of a labelled CSV; a missing column is an error."""
    return spark.read.csv(path, header=True).select(F.col(f"`{key}`").alias("key"), (F.upper(F.trim(label)) == "TRUE").alias("binds"))


def submission(spark: SparkSession, path: str) -> DataFrame:
    """(key, score): the first two words before a line's first tab; shorter lines are skipped, of repeated keys the last line counts."""
    words = F.split(F.trim(F.split_part("value", F.lit("\t"), F.lit(1))), r"\s+")
    rows = spark.read.text(path).select(words.alias("w"), F.monotonically_increasing_id().alias("at")).where("size(w) >= 2")
    return rows.groupBy(F.col("w")[0].alias("key")).agg(F.max_by(F.col("w")[1].try_cast("double"), "at").alias("score"))


def clusters(spark: SparkSession, path: str) -> DataFrame:
    """(member, rep, size) of a headerless table of representatives and members."""
    rows = headerless(spark, path, ["rep", "member"], 2)
    return rows.withColumn("size", F.count(F.lit(1)).over(Window.partitionBy("rep"))).select("member", "rep", "size")


def components(spark: SparkSession, path: str) -> DataFrame:
    """(id, nth, code, smiles, n): a CSV's repeated triples by position; blank codes are skipped, a blank count is 1.

    The header line names every triple, so it tells how many there are.
    """
    header = spark.read.text(path).limit(1).collect()
    most = header[0].value.count(",") // 3 if header else 0
    width = 1 + 3 * max(1, most)
    fields = F.from_csv("value", ", ".join(f"c{i} string" for i in range(width)), {"mode": "PERMISSIVE"})
    rows = spark.read.text(path).select(fields.alias("f")).select(F.array(*[F.trim(F.col(f"f.c{i}")) for i in range(width)]).alias("f"))
    at = F.explode(F.sequence(F.lit(0), F.lit(max(1, most) - 1))).alias("nth")
    triple = rows.where(F.coalesce(F.col("f")[0], F.lit("")) != "").select(F.col("f")[0].alias("id"), at, "f")
    out = triple.select("id", "nth", *[F.get("f", 1 + 3 * F.col("nth") + i).alias(c) for i, c in enumerate(("code", "smiles", "count"))])
    # the header's own count is no number
    counted = out.withColumn("n", F.coalesce(F.nullif("count", F.lit("")), F.lit("1")).try_cast("int"))
    return counted.where((F.coalesce("code", F.lit("")) != "") & F.col("n").isNotNull()).drop("count")


def pockets(spark: SparkSession, path: str, k: int) -> DataFrame:
    """The first ``k`` pockets of each CSV: rank, centre and score; names and values may be padded, an absent score is 0."""
    rows = spark.read.csv(path, header=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    value = lambda c: F.trim(F.col(f"`{c}`")).try_cast("double")
    numbered = rows.withColumn("_at", F.monotonically_increasing_id()).withColumn("_file", F.input_file_name())
    rank = F.row_number().over(Window.partitionBy("_file").orderBy("_at"))
    found = numbered.withColumn("rank", rank).where(F.col("rank") <= k)
    return found.select("rank", *[value(f"center_{a}").alias(a) for a in "xyz"], F.coalesce(value("score"), F.lit(0.0)).alias("score"))


def named_links(pages: DataFrame, key: str, html: str, pattern: str) -> DataFrame:
    """key, name (upper case), target: the links of each page, where ``pattern`` has the target and the name as groups 1 and 2.

    Of links of one name the last one counts.
    """
    found = pages.select(key, F.posexplode(F.regexp_extract_all(html, F.lit(pattern), F.lit(0))).alias("_at", "_link"))
    parts = found.select(key, "_at", F.upper(F.regexp_extract("_link", pattern, 2)).alias("name"), F.regexp_extract("_link", pattern, 1).alias("target"))
    return parts.groupBy(key, "name").agg(F.max_by("target", "_at").alias("target"))


def alignment_records(spark: SparkSession, path: str) -> DataFrame:
    """file, nth, header, sequence of tables of keys and sequences; the first record is the query, others are named by place and key.

    Files whose first line doesn't begin with ``key`` give nothing; lines without a comma are skipped but counted.
    """
    lines = numbered(lines_of(spark, path))
    good = lines.where((F.col("record") == 1) & F.col("value").startswith("key")).select("file")
    rows = lines.where("record > 1").join(good, "file", "left_semi").withColumn("nth", F.col("record") - 2)
    comma = F.instr("value", ",")
    name = F.when(F.col("nth") == 0, ">query").otherwise(F.concat(F.lit(">seq_"), F.col("nth"), F.lit("_key_"), F.substring(F.col("value"), F.lit(1), comma - 1)))
    return rows.where(comma > 0).select("file", "nth", name.alias("header"), F.substring(F.col("value"), comma + 1, F.length("value")).alias("sequence"))


def pose_metrics(spark: SparkSession, families: dict[str, dict[str, str]]) -> DataFrame:
    """name and the metrics of all families: {pattern of tab-separated files: {column: metric}}.

    Names lose a repeated index; of a name's values of a metric the last one that is a number counts, NULL if none is.
    """
    whole = None
    for pattern, columns in families.items():
        rows = spark.read.csv(pattern, sep="\t", header=True).withColumns({"_at": F.monotonically_increasing_id(), "name": once_indexed(F.trim(F.coalesce("Name", F.lit(""))))})
        values = {out: number(F.trim(F.col(f"`{c}`"))) if c in rows.columns else F.lit(None).cast("double") for c, out in columns.items()}
        rows = rows.where("name != ''").select("name", "_at", *[v.alias(out) for out, v in values.items()])
        last = [F.max_by(out, F.when(F.col(out).isNotNull(), F.col("_at"))).alias(out) for out in values]
        found = rows.groupBy("name").agg(*last)
        whole = found if whole is None else whole.join(found, "name", "full_outer")
    return whole
