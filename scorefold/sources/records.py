"""Readers of structure files: fixed-width atoms, molecule records and models of submissions.

Records end where Spark's text reader is told that lines end, so one that crosses the edge of two splits is read once
and a file of any size is read by many tasks. Every reader keeps the ``file`` and, within it, the order of records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

HYDROGEN = ("H", "D")


def lines_of(spark: SparkSession, path: str, end: str | None = None) -> DataFrame:
    """file, at (grows along a file), value: the lines of all files, or the records between two ``end``."""
    rows = spark.read.text(path, lineSep=end) if end else spark.read.text(path)
    return rows.select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("at"), "value")


def numbered(rows: DataFrame) -> DataFrame:
    """Adds ``record``, a row's number in its file from 1: rows of a file follow each other in a task, so counts by file and task do."""
    task = F.shiftright("at", 33)
    runs = rows.groupBy("file", task.alias("task")).agg(F.min("at").alias("start"), F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("file").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.select("file", "task", "start", F.coalesce(before, F.lit(0)).alias("before"))
    joined = rows.withColumn("task", task).join(runs, ["file", "task"])
    return joined.withColumn("record", F.col("before") + F.col("at") - F.col("start") + 1).drop("task", "start", "before")


def _field(line: Column, start: int, end: int) -> Column:
    """Characters from ``start`` up to ``end``, counted from 0."""
    return F.substring(line, start + 1, end - start)


def _number(text: Column, kind: str = "double") -> Column:
    """A number with white space around it; other text, and a number without digits, is NULL."""
    return F.trim(text).try_cast(kind)


def _point(line: Column) -> list[Column]:
    return [_number(_field(line, a, a + 8)).alias(c) for c, a in zip("xyz", (30, 38, 46), strict=True)]


def ca_atoms(spark: SparkSession, path: str, chain: str | None = "A") -> DataFrame:
    """file, resid, x, y, z of the CA atoms of a chain (of all where it is None); of repeated numbers the last line counts.

    ATOM lines with a number or coordinate that can't be read are skipped.
    """
    line = F.col("value")
    kept = line.startswith("ATOM") & (F.trim(_field(line, 12, 16)) == "CA")
    if chain is not None:
        kept = kept & (_field(line, 21, 22) == chain)
    atoms = lines_of(spark, path).where(kept).select("file", "at", _number(_field(line, 22, 26), "int").alias("resid"), *_point(line)).dropna()
    last = atoms.groupBy("file", "resid").agg(F.max_by(F.struct("x", "y", "z"), "at").alias("p"))
    return last.select("file", "resid", "p.*")


def heavy_atoms(spark: SparkSession, path: str) -> DataFrame:
    """file, at, chain, element, x, y, z of ATOM and HETATM lines but hydrogen and deuterium.

    The element is that of columns 77 and 78, else the first letter of the atom's name.
    """
    line = F.col("value")
    given = F.trim(_field(line, 76, 78))
    element = F.when(given != "", given).otherwise(F.substring(F.trim(_field(line, 12, 16)), 1, 1))
    rows = lines_of(spark, path).where(line.startswith("ATOM") | line.startswith("HETATM"))
    atoms = rows.select("file", "at", _field(line, 21, 22).alias("chain"), element.alias("element"), *_point(line))
    return atoms.where(~F.col("element").isin(*HYDROGEN)).dropna(subset=["x", "y", "z"])


def molecules(spark: SparkSession, path: str) -> DataFrame:
    """file, record (from 1), name, elements, atoms: the heavy atoms of each V2000 record that has any.

    The fourth line counts the atoms; atom lines that are too short or hold no coordinates are skipped, and records
    without a count too. ``record`` counts all records of a file.
    """
    lines = F.split(F.regexp_replace("value", "\r", ""), "\n")
    # what follows the end of a record is the rest of its line
    rows = numbered(lines_of(spark, path, "$$$$")).select("file", "record", lines.alias("l"))
    rows = rows.withColumn("l", F.when(F.col("record") == 1, F.col("l")).otherwise(F.slice("l", 2, F.greatest(F.lit(0), F.size("l") - 1))))
    count = _number(_field(F.get("l", F.lit(3)), 0, 3), "int")
    atoms = F.transform(
        F.slice("l", 5, F.greatest(F.lit(0), F.col("n"))),
        lambda a: F.struct(*[_number(_field(a, i * 10, i * 10 + 10)).alias(c) for i, c in enumerate("xyz")], F.trim(_field(a, 31, 34)).alias("element"), (F.length(a) >= 34).alias("long")),
    )
    heavy = F.filter(atoms, lambda a: a["long"] & a["x"].isNotNull() & a["y"].isNotNull() & a["z"].isNotNull() & ~a["element"].isin(*HYDROGEN))
    found = rows.where(F.size("l") >= 4).withColumn("n", count).where("n IS NOT NULL").withColumn("atoms", heavy).where(F.size("atoms") > 0)
    point = F.transform("atoms", lambda a: F.struct(a["x"].alias("x"), a["y"].alias("y"), a["z"].alias("z")))
    return found.select("file", "record", F.trim(F.col("l")[0]).alias("name"), F.transform("atoms", lambda a: a["element"]).alias("elements"), point.alias("atoms"))


def models(spark: SparkSession, path: str) -> DataFrame:
    """file, idx, name, score, affinity, atoms (lines), molecule (text) and file_affinity of each MODEL of submissions.

    A MODEL reaches to the next line that begins with that word. Its name is the first line after LIGAND that is blank
    neither nor a record, its molecule what follows up to another LIGAND, without ATOM, HETATM, TER, LSCORE and AFFNTY
    lines. The last LSCORE and AFFNTY that can be read count, and of the whole file, wherever it stands, the last AFFNTY.
    """
    rows = numbered(lines_of(spark, path, "\nMODEL")).select("file", "record", F.regexp_replace("value", "\r", "").alias("value"))
    head = (F.col("record") == 1) & ~F.col("value").startswith("MODEL")
    body = F.when((F.col("record") == 1) & ~head, F.substring("value", 6, 1 << 30)).otherwise(F.col("value"))
    rows = rows.select("file", "record", head.alias("head"), F.split(body, "\n").alias("l"))
    begins = lambda x, *words: x.rlike(f"^({'|'.join(words)})")
    second = lambda x: F.get(F.filter(F.split(x, r"\s+"), lambda w: w != ""), F.lit(1)).try_cast("double")

    def last(word: str) -> Column:
        read = F.filter(F.transform(F.filter("l", lambda x: begins(x, word)), second), lambda v: v.isNotNull())
        return F.get(read, F.size(read) - 1)

    rows = rows.withColumns({"affinity": last("AFFNTY"), "score": last("LSCORE"), "idx": F.regexp_extract(F.get("l", F.lit(0)), r"^\s+(\d+)", 1).try_cast("int")})
    whole = rows.where("affinity IS NOT NULL").groupBy("file").agg(F.max_by("affinity", "record").alias("file_affinity"))
    rows = rows.where(~F.col("head") & F.col("idx").isNotNull()).join(whole, "file", "left")
    record = lambda x: begins(x, "ATOM", "HETATM", "TER")
    # lines after the first LIGAND that are no records, LIGAND lines among them
    at = F.array_position(F.transform("l", lambda x: begins(x, "LIGAND")), F.lit(True))
    rest = F.filter(F.slice("l", at.cast("int") + 1, F.size("l")), lambda x: ~record(x) & ~begins(x, "LSCORE", "AFFNTY"))
    rows = rows.withColumn("rest", F.when(at > 0, rest).otherwise(F.slice("l", 1, 0)))
    named = F.array_position(F.transform("rest", lambda x: (F.trim(x) != "") & ~begins(x, "LIGAND")), F.lit(True)).cast("int")
    rows = rows.withColumns({"named": named, "name": F.when(named > 0, F.trim(F.get("rest", named - 1)))})
    tail = F.when(F.col("named") > 0, F.slice("rest", F.col("named") + 1, F.size("rest"))).otherwise(F.slice("rest", 1, 0))
    again = F.array_position(F.transform(tail, lambda x: begins(x, "LIGAND")), F.lit(True)).cast("int")
    molecule = F.when(again > 0, F.slice(tail, F.lit(1), again - 1)).otherwise(tail)
    return rows.select("file", "idx", "name", "score", "affinity", F.filter("l", record).alias("atoms"), F.array_join(molecule, "\n").alias("molecule"), "file_affinity")
