"""A corpus pipeline of five stages over ``documents``; each stage is written as Parquet and reread as the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from scorefold.llm import exact_dedup, mixing, near_dedup, packing, toxicity
from scorefold.llm.common import materialise, table

#: (name, function of (spark, docs, sf_dir)), in order.
STAGES = [
    ("toxicity", toxicity.stage),
    ("exact_dedup", exact_dedup.stage),
    ("near_dedup", near_dedup.stage),
    ("mixing", mixing.stage),
    ("packing", packing.stage),
]

#: Toxicity is a trained model, near-duplicates a sampled search, packing a sequence of rounds: no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
