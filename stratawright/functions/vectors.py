"""Vectors as arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2_normalize(vector: Column) -> Column:
    """Unit vector; a vector of zeros is an error."""
    norm = F.sqrt(dot(vector, vector))
    return F.when(norm == 0, F.raise_error(F.lit("zero vector"))).otherwise(F.transform(vector, lambda x: x.cast("double") / norm))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))
