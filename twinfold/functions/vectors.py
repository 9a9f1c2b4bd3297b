"""Vector arithmetic as Column expressions, for a handful of pairs; bulk pairs go through operators.similarity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """0 for null, empty, unequal length or zero vectors, never NaN."""
    sized = (F.size(a) > 0) & (F.size(a) == F.size(b))
    length = F.when(sized, norm(a) * norm(b))
    return F.when(F.coalesce(length, F.lit(0.0)) == 0.0, 0.0).otherwise(dot(a, b) / F.nullif(length, F.lit(0.0)))


def unit(v: Column) -> Column:
    """Of length 1; a zero vector stays as it is."""
    size = norm(v)
    return F.when(size == 0.0, v).otherwise(F.transform(v, lambda x: x / F.nullif(size, F.lit(0.0))))
