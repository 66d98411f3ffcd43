"""Weighted fusion of keyword and vector candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions.scores import bm25_to_score, distance_to_score

#: Weights of the two sides, the least score kept, and how many candidates a result needs.
VECTOR_WEIGHT, TEXT_WEIGHT, LEAST_SCORE, OVERFETCH = 0.7, 0.3, 0.1, 4


def fuse(text: DataFrame, vectors: DataFrame, limit: int, vector_weight: float = VECTOR_WEIGHT, text_weight: float = TEXT_WEIGHT, least: float = LEAST_SCORE) -> DataFrame:
    """(rowid, text_score, vector_score, final_score) of text(rowid, rank) and vectors(rowid, distance), best first.

    A full outer join in which a missing side counts as 0. Both sides are
    candidate lists of a few times `limit` rows, whatever the collection.
    """
    t = text.select("rowid", bm25_to_score(F.col("rank")).alias("text_score"))
    v = vectors.select("rowid", distance_to_score(F.col("distance")).alias("vector_score"))
    both = t.join(v, "rowid", "full_outer").fillna(0.0, ["text_score", "vector_score"])
    score = F.lit(vector_weight) * F.col("vector_score") + F.lit(text_weight) * F.col("text_score")
    return both.withColumn("final_score", score).where(F.col("final_score") >= least).orderBy(F.desc("final_score"), "rowid").limit(limit)
