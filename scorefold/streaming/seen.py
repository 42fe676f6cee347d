"""A stream's rows whose key hasn't been seen before."""

from __future__ import annotations

from pyspark.sql import DataFrame


def unseen(stream: DataFrame, keys: list[str], time: str | None = None, delay: str = "1 day") -> DataFrame:
    """First row of each key; with a time column keys are forgotten once ``delay`` has passed."""
    if time is None:
        return stream.dropDuplicates(keys)
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)
