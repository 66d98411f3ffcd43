"""Bounded samples for fitting models on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def least_hashes(df: DataFrame, keys: list[str], text: str, n: int) -> list[str]:
    """The texts of about the `n` rows of least key hash (2 n at most); only hashes are compared across tasks."""
    rows = df.where(F.col(text).isNotNull()).select(F.xxhash64(*keys).alias("_h"), F.col(text).alias("_t"))
    last = rows.select("_h").orderBy("_h").limit(n).agg(F.max("_h")).first()[0]
    if last is None:
        return []
    found = rows.where(F.col("_h") <= last).limit(2 * n).collect()
    return [r[1] for r in sorted(found, key=lambda r: (r[0], r[1]))]
