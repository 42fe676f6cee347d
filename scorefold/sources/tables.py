"""Typed scans of delimited tables; never with inferred schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.parsing import number

SEQUENCE_HITS = "query target pident alnlen mismatch gapopen qstart qend tstart tend evalue bits qlen tlen".split()
STRUCTURE_HITS = "query target evalue bits alntmscore qtmscore ttmscore prob".split()


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def headerless(spark: SparkSession, path: str, columns: list[str], least: int, sep: str = "\t") -> DataFrame:
    """Text columns by position; rows of fewer than ``least`` fields are skipped, absent fields are NULL."""
    fields = F.split("value", sep)
    rows = spark.read.text(path).withColumn("_fields", fields).where(F.size("_fields") >= least)
    return rows.select(*[F.get("_fields", F.lit(i)).alias(c) for i, c in enumerate(columns)])


def numeric(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: number(F.col(c)) for c in columns})


def search_hits(spark: SparkSession, sequence_path: str, structure_path: str) -> DataFrame:
    """Both kinds of hits under one schema, with their source."""
    texts = ["query", "target"]
    sequence = headerless(spark, sequence_path, SEQUENCE_HITS, 12)
    structure = headerless(spark, structure_path, STRUCTURE_HITS, 8)
    both = [
        numeric(d, [c for c in d.columns if c not in texts]).withColumn("source", F.lit(s))
        for d, s in ((sequence, "sequence"), (structure, "structure"))
    ]
    return both[0].unionByName(both[1], allowMissingColumns=True)


def predictions(spark: SparkSession, pattern: str, prefix: str, values: list[str]) -> DataFrame:
    """Headed tables named ``prefix`` + tool: Name and numeric ``values``; rows with a blank name or a bad number are skipped.

    Of a tool's repeated names the last row counts.
    """
    df = spark.read.csv(pattern, sep="\t", header=True).withColumn("_at", F.monotonically_increasing_id())
    named = df.withColumn("tool", F.regexp_extract(F.input_file_name(), rf"{prefix}([^/]*?)\.[^./]*$", 1))
    kept = numeric(named, values).where(F.trim("Name") != "")
    rows = kept.dropna(subset=values).groupBy("tool", F.trim("Name").alias("name"))
    return rows.agg(F.max_by(F.struct(*values), "_at").alias("_v")).select("tool", "name", "_v.*")
