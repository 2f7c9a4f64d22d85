"""Vector functions as Column expressions over arrays."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def cosine_to(v: Column, query: list[float]) -> Column:
    """Cosine similarity to a vector that the driver has; its norm is taken out once."""
    norm = math.sqrt(sum(float(x) ** 2 for x in query)) or 1.0
    return dot(v, F.array(*[F.lit(float(x) / norm) for x in query])) / F.sqrt(dot(v, v))


def valid(v: Column, dimension: int) -> Column:
    return F.coalesce((F.size(v) == dimension) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))), F.lit(False))
