"""Exact nearest neighbours of one query vector."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions.scores import cosine_distance


def nearest(vectors: DataFrame, query: list[float], k: int, id_: str = "rowid", vector: str = "embedding", unique: bool = False) -> DataFrame:
    """The `k` rows of least cosine distance, ties by id.

    Distances are built-in expressions in doubles over one scan. Vectors
    without a direction, of another length or with a null or NaN element are
    left out; a repeated row counts once. Repetitions are folded by a partial
    aggregate of ids and distances; where ids are `unique`, as in a stored
    collection, that is left out and each task keeps its own `k` rows.
    """
    q = F.array(*[F.lit(float(x)) for x in query])
    found = vectors.where(F.col(vector).isNotNull()).select(id_, cosine_distance(F.col(vector), q).alias("distance")).where(F.col("distance").isNotNull())
    if not unique:
        found = found.groupBy(id_).agg(F.min("distance").alias("distance"))
    return found.orderBy("distance", id_).limit(k)
