"""Column expressions that derive typed columns from scores and names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def missing(text: Column) -> Column:
    """Empty text, None and NaN become NULL."""
    return F.when(~F.trim(text).isin("", "None", "NaN"), text)


def number(text: Column) -> Column:
    """A double, NULL where the text is missing or no number."""
    value = missing(text).try_cast("double")
    return F.when(~F.isnan(value), value)


def closeness(p_far: Column) -> Column:
    """1 - probability of being far, kept within 0 and 1; NULL stays NULL."""
    return F.when(p_far.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - p_far)))


def log_affinity(pkd: Column) -> Column:
    """log10 of the affinity in nM from a pKd in M."""
    return 9 - pkd


def seed(name: Column) -> Column:
    return F.nullif(F.regexp_extract(name, r"_seed[_-](\d+)", 1), F.lit("")).cast("int")


def trailing_index(name: Column) -> Column:
    return F.nullif(F.regexp_extract(name, r"_(\d+)$", 1), F.lit("")).cast("int")


def once_indexed(name: Column) -> Column:
    """``a_3_3`` becomes ``a_3``."""
    return F.regexp_replace(name, r"_(\d+)_\1$", "_$1")


def prefix_family(name: Column, prefixes: list[str]) -> Column:
    """The longest of ``prefixes`` that a name begins with, else the name."""
    found = F.lit(None).cast("string")
    for p in sorted(prefixes, key=len):
        found = F.when(name.startswith(p), F.lit(p)).otherwise(found)
    return F.coalesce(found, name)


def key_parts(target: Column) -> tuple[Column, Column]:
    """(lower-case entry, chain) of ``entry_chain``; without ``_`` the first four characters and an empty chain."""
    split = F.split(target, "_")
    return F.lower(F.when(target.contains("_"), split[0]).otherwise(F.substring(target, 1, 4))), F.when(target.contains("_"), split[1]).otherwise("")
