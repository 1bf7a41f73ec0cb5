"""Vector expressions over array columns, computed in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity, clamped to [-1, 1]; null where a norm is zero."""
    length = norm(a) * norm(b)
    return F.when(length > 0, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / length)))
