"""Exact deduplication as a stateful stream whose keyed state lies on disk and never expires.

Each ingest lands the narrow columns (digest, stable identifier, content locator) of new documents
in a folder; a Structured Streaming query reads that folder and keeps, per digest, the smallest
identifier, the locator of its content and a count in RocksDB state stores. The checkpoint holds
the state, so a later ingest continues from it and a lost executor restores its share. Hits (digests
met more than once) are then compared by their full bytes, which are read through the locators: the
files that hold those documents, of earlier ingests as well.

Defined cases: null text counts as empty; of equal texts the smallest doc_id stays, null ids come
last; rows repeated with the same doc_id and text keep exactly one of them; an empty table gives an
empty result; further columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import materialise, numbered, place_in_files, scratch, table

#: State on disk; without room reserved ahead, as there may be many small state stores.
STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}
LANDED = "text_sha256 string, doc_id bigint, locator string, n_bytes bigint, row string"


def normalised(text: Column) -> Column:
    """Runs of ASCII white space become one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+", " ")


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


class StreamingDeduplicator:
    """Keyed state of all documents ingested so far, under ``store``; ``row`` names a column with the place of a row in its file."""

    def __init__(self, spark: SparkSession, store: str | None = None, digest: Callable[[Column], Column] = sha256, row: str | None = None):
        self.spark, self.digest = spark, digest
        self.name = row
        self.row = (F.col(row) if row else F.lit(None)).cast("string").alias("row")
        self.store = store or scratch(spark, "exact-dedup")

    def keyed(self, docs: DataFrame) -> DataFrame:
        text = normalised(F.col("text"))
        return docs.select(
            self.digest(text).alias("text_sha256"),
            F.col("doc_id").cast("bigint").alias("doc_id"),
            F.input_file_name().alias("locator"),
            F.octet_length(text).cast("bigint").alias("n_bytes"),
            self.row,
        )

    def ingest(self, docs: DataFrame) -> None:
        """Land new documents' digests and advance the stream over them."""
        landing = f"{self.store}/landing"
        self.keyed(docs).write.mode("append").parquet(landing)
        spark = self.spark
        previous = {key: spark.conf.get(key, None) for key in STATE_CONF}
        for key, value in STATE_CONF.items():
            spark.conf.set(key, value)
        try:
            (
                spark.readStream.schema(LANDED)
                .parquet(landing)
                .groupBy("text_sha256")
                .agg(
                    F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "locator", "n_bytes")).alias("first"),
                    F.count(F.lit(1)).alias("group_size"),
                )
                .writeStream.format("noop")
                .outputMode("update")
                .option("checkpointLocation", f"{self.store}/checkpoint")
                .trigger(availableNow=True)
                .start()
                .awaitTermination()
            )
        finally:
            for key, value in previous.items():
                spark.conf.unset(key) if value is None else spark.conf.set(key, value)

    def state(self) -> DataFrame:
        """text_sha256, keep_id, keep_locator, group_size of every digest seen."""
        read = self.spark.read.format("statestore").load(f"{self.store}/checkpoint")
        kinds = {f.name: f.dataType for f in read.schema["value"].dataType.fields}
        first = next(n for n, t in kinds.items() if isinstance(t, T.StructType))
        count = next(n for n, t in kinds.items() if isinstance(t, T.LongType))
        return read.select(
            F.col("key.text_sha256").alias("text_sha256"),
            F.col("value")[first]["doc_id"].alias("keep_id"),
            F.col("value")[first]["locator"].alias("keep_locator"),
            F.col("value")[count].alias("group_size"),
        )

    def contents(self, locators: DataFrame) -> DataFrame:
        """The documents of the files that ``locators`` names; the driver holds the names of files only."""
        paths = [r.locator for r in locators.select("locator").distinct().collect()]
        if not all(paths):
            raise ValueError("documents that don't come from files have no locator: hand them in again")
        found = self.spark.read.parquet(*paths)
        return found.withColumn(self.name, place_in_files()) if self.name else found

    def resolve(self, docs: DataFrame | None = None) -> DataFrame:
        """One row per document ingested: doc_id, keep_id, group_size, kept, text_sha256, keep_locator, row.

        The bytes of hits are read through their locators; ``docs`` are needed for documents without one.
        """
        landed = self.spark.read.schema(LANDED).parquet(f"{self.store}/landing")
        found = materialise(landed.select("doc_id", "text_sha256", "row", "locator").join(self.state(), "text_sha256"), "dedup-found")
        hit_rows = found.where("group_size > 1")
        found = found.drop("locator")
        if docs is None:
            if not hit_rows.take(1):
                return self.decided(found)
            docs = self.contents(hit_rows)
        # full bytes of the hits: groups of one digest must hold one text
        hit_ids = hit_rows.select("doc_id").distinct()
        texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), normalised(F.col("text")).alias("bytes"), self.row)
        hits = texts.join(hit_ids, texts.doc_id.eqNullSafe(hit_ids.doc_id), "left_semi")
        digest = self.digest(F.col("bytes")).alias("text_sha256")
        variants = (
            hits.select(digest, "bytes", "doc_id")
            .groupBy("text_sha256", "bytes")
            .agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        )
        clashing = materialise(variants.groupBy("text_sha256").count().where("count > 1").select("text_sha256"), "dedup-clash")
        if clashing.take(1):  # different texts of one digest: their rows are told apart by the bytes
            rows = texts.select("doc_id", "bytes", "row", digest).join(clashing, "text_sha256", "left_semi")
            apart = rows.join(
                variants.withColumnsRenamed({"bytes": "b", "text_sha256": "d"}),
                (F.col("text_sha256") == F.col("d")) & (F.col("bytes") == F.col("b")),
            ).select("text_sha256", "doc_id", "keep_id", F.lit(None).cast("string").alias("keep_locator"), "group_size", "row")
            found = found.join(clashing, "text_sha256", "left_anti").unionByName(apart)
        return self.decided(found)

    @staticmethod
    def decided(found: DataFrame) -> DataFrame:
        """Adds which row of each group stays."""
        copy = F.row_number().over(Window.partitionBy("doc_id", "text_sha256", "keep_id").orderBy("keep_locator", "row"))
        return found.withColumn("copy", copy).select(
            "doc_id",
            "keep_id",
            "group_size",
            (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"),
            "text_sha256",
            "keep_locator",
            "row",
        )


def exact_dedup(docs: DataFrame, digest: Callable[[Column], Column] = sha256, in_files: bool = False) -> DataFrame:
    """All of ``docs`` in one ingest into fresh state; ``in_files``: they are a plain read of Parquet files."""
    dedup = StreamingDeduplicator(docs.sparkSession, digest=digest)
    dedup.ingest(docs)
    return dedup.resolve(None if in_files else docs).drop("row")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents that stay, with their own columns, whatever their names."""
    rows, row = numbered(docs, "dedup-input")
    dedup = StreamingDeduplicator(spark, row=row)
    dedup.ingest(rows)
    kept = dedup.resolve().where("kept").select(F.col("row").alias(row))
    return rows.join(kept, row, "left_semi").select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup(table(spark, sf_dir, "documents"), in_files=True)
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


ORACLE_SQL = r"""
WITH t AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
  FROM documents
), g AS (
  SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY text_sha256
)
SELECT t.doc_id, g.keep_id, g.group_size, t.text_sha256,
  t.doc_id IS NOT DISTINCT FROM g.keep_id AND row_number() OVER (PARTITION BY t.text_sha256, t.doc_id) = 1 AS kept
FROM t JOIN g USING (text_sha256)
"""
