"""What the corpus operators share: table access, scratch tables, folds and bounded training samples."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows per Arrow batch handed to a Python worker; Spark's ``spark.sql.execution.arrow.maxBytesPerBatch``
#: (64 MB unless set) bounds a batch's bytes as well, so long texts come in small batches.
ARROW_ROWS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share.

    The cluster names that folder in ``spark.checkpoint.dir``; where it is unset, a folder in the warehouse serves,
    which driver and executors share as well.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir')}/_rounds"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def place_in_files() -> Column:
    """Tells the rows of Parquet files apart: file and place in it."""
    return F.concat_ws("#", F.col("_metadata.file_path"), F.col("_metadata.row_index").cast("string"))


def whole_read(docs: DataFrame) -> bool:
    """Whether ``docs`` is a read of Parquet files with all their rows, by whose places its rows can be told apart.

    What drops or repeats rows of the files has another number of rows; the counts come from the files' footers.
    """
    try:
        docs.select(place_in_files())
    except AnalysisException:
        return False
    return docs.count() == docs.sparkSession.read.parquet(*docs.inputFiles()).count()


def numbered(docs: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``docs`` with a column that no two rows share, and its name, with which no other begins.

    Rows of Parquet files are told apart by their place; what isn't a read of whole files is written first.
    """
    row = "_row"
    while any(c.lower().startswith(row) for c in docs.columns):
        row = f"_{row}"
    return (docs if whole_read(docs) else materialise(docs, name)).withColumn(row, place_in_files()), row


def spread(scan: DataFrame) -> DataFrame:
    """A read of few files dealt to all cores, so that Python tasks on a small table use them; larger ones stay as they are."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def map_arrow(df: DataFrame, function: Callable, schema: str) -> DataFrame:
    """``mapInArrow`` with batches of at most ARROW_ROWS rows; sets that bound in the session, where it stays."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    return df.mapInArrow(function, schema)


def fold(doc_id: Column, folds: int = 5) -> Column:
    """crc32 of the id as text, modulo ``folds``; fold 0 is held out of every fit."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")), F.lit(1)) % folds


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, limit: int, max_bytes: int, seed: int = 7
) -> list[tuple[str, int]]:
    """(text, label) of at most ``limit`` labelled rows outside fold 0, each text of at most ``max_bytes``.

    Half of the places go to label 1 and half to label 0 as far as there are such rows; within a
    label the order is that of a hash of the id. A document with several labels counts with the
    largest one; null labels don't count. The bound holds at every size of input, so the sample may
    be collected; whole texts are used.
    """
    ranked = (
        labels.select("doc_id", F.col(label).cast("int").alias("y"))
        .where(F.col("y").isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) != 0))
        .groupBy("doc_id")
        .agg(F.max("y").alias("y"))
        .withColumn("h", F.xxhash64("doc_id", F.lit(seed)))
    )
    ids = None
    for value in (0, 1):
        part = ranked.where(F.col("y") == value).orderBy("h", "doc_id").limit(limit // 2)
        ids = part if ids is None else ids.unionByName(part)
    rows = (
        docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
        .where(F.octet_length("text") <= max_bytes)
        .join(F.broadcast(ids.select("doc_id", "y", "h")), "doc_id")  # at most `limit` rows
        .orderBy("h", "doc_id")
        .limit(limit)
        .select("text", "y")
        .collect()
    )
    return [(r.text, r.y) for r in rows]
