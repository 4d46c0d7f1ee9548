"""Vector arithmetic on array columns, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(left: Column, right: Column) -> Column:
    return F.aggregate(
        F.zip_with(left, right, lambda a, b: a.cast("double") * b.cast("double")),
        F.lit(0.0),
        lambda total, x: total + x,
    )


def l2_norm(vector: Column) -> Column:
    return F.sqrt(
        F.aggregate(vector, F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double"))
    )


def l2_normalize(vector: Column) -> Column:
    """Scale to unit length; a zero vector stays as it is."""
    norm = l2_norm(vector)
    return F.when(norm > 0, F.transform(vector, lambda x: x.cast("double") / norm)).otherwise(
        vector.cast("array<double>")
    )


def cosine(left: Column, right: Column) -> Column:
    scale = l2_norm(left) * l2_norm(right)
    return F.when(scale > 0, dot(left, right) / scale)
