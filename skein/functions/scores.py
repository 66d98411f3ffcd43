"""Scalar scores and distances."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bm25_to_score(rank: Column) -> Column:
    """A bm25 rank (negative is better) as a score in [0, 1); ranks that are null or not finite give 0."""
    finite = rank.isNotNull() & ~F.isnan(rank) & (F.abs(rank) < float("inf"))
    p = F.when(finite, F.greatest(-rank, F.lit(0.0))).otherwise(F.lit(0.0))
    return p / (F.lit(1.0) + p)


def distance_to_score(distance: Column) -> Column:
    """A cosine distance as a score, at least 0; null and NaN give 0."""
    return F.when(distance.isNull() | F.isnan(distance), F.lit(0.0)).otherwise(F.greatest(F.lit(1.0) - distance, F.lit(0.0)))


def dot(x: Column, y: Column) -> Column:
    """The inner product in doubles."""
    products = F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, v: s + v)


def cosine_distance(x: Column, y: Column) -> Column:
    """1 - cosine, never below 0; null where a vector has no direction, other length, or a null or NaN element."""
    norms = F.sqrt(dot(x, x) * dot(y, y))
    d = F.when((F.size(x) == F.size(y)) & (norms > 0), F.lit(1.0) - dot(x, y) / norms)
    return F.when(d.isNotNull() & ~F.isnan(d), F.greatest(d, F.lit(0.0)))
