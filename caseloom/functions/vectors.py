"""Vector functions on array columns, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-12


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Dot product over norms of at least EPS, so a zero vector scores 0."""
    return dot(a, b) / (F.greatest(norm(a), F.lit(EPS)) * F.greatest(norm(b), F.lit(EPS)))


def unit(a: Column) -> Column:
    n = F.greatest(norm(a), F.lit(EPS))
    return F.transform(a, lambda x: x.cast("double") / n)


SIMILARITIES = {"dot": dot, "cos": cosine}


def similarity(metric: str):
    if metric not in SIMILARITIES:
        raise ValueError(f"metric must be one of {sorted(SIMILARITIES)}, not {metric!r}")
    return SIMILARITIES[metric]
