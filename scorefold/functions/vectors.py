"""Column expressions on arrays of coordinates and of bits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def index_rmsd(a: Column, b: Column) -> Column:
    """Root mean square of the differences by index; NULL where the shapes differ or are empty."""
    squares = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    total = F.aggregate(squares, F.lit(0.0), lambda s, x: s + x)
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0), F.sqrt(total / F.size(a)))


def tanimoto(a: Column, b: Column) -> Column:
    """Shared on-bits over all on-bits; 0 where one is missing or both are empty."""
    return F.coalesce(F.size(F.array_intersect(a, b)) / F.nullif(F.size(F.array_union(a, b)), F.lit(0)), F.lit(0.0))


def transformed(x: Column, y: Column, z: Column, rotation: list[list[float]], shift: list[float]) -> list[Column]:
    """The point R x + t."""
    return [r[0] * x + r[1] * y + r[2] * z + t for r, t in zip(rotation, shift, strict=True)]
