"""Column expressions on embedding arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Dot product in double precision."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; NULL when either has no length."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms > 0, dot(a, b) / norms)


def similarity_score(cosine_value: Column) -> Column:
    """Cosine mapped onto [0, 1]."""
    return F.least(F.greatest((cosine_value + 1.0) / 2.0, F.lit(0.0)), F.lit(1.0))
