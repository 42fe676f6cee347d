"""Cutting the lineage of tables that rounds build on."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, else one in the warehouse."""
    return (spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir')}/_rounds").rstrip("/")


def settled(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back, for ``DataFrame.transform``.

    What is read back has the size of its files. A checkpoint would keep the optimiser's estimate, which every
    join of a round multiplies, until planning a round takes longer than running it.
    """
    path = f"{shared_folder(df.sparkSession)}/settled-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows that a task of ``dealt`` gets, about.
ROWS = 100_000


def dealt(df: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` by ``keys`` in parts of about ROWS rows, however many it has, for steps that sort a part several times at once."""
    return df.repartition(-(-df.count() // ROWS) or 1, *keys)
