"""Joins by keys of which one may hold a third of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of one key that one task joins. Keys with more are listed; there are at most rows / HOT of them, which bounds the broadcast.
HOT = 100_000


def hot_keys(counted: DataFrame, key: str, n: str = "n", size: int | None = None) -> DataFrame:
    """(key, _blocks) of the keys with more than `size` rows (HOT by default), from counted(key, n)."""
    size = size or HOT
    return counted.where(F.col(n) > size).select(key, F.ceil(F.col(n) / size).cast("int").alias("_blocks"))


def in_own_block(df: DataFrame, key: str, hot: DataFrame, *by: str) -> DataFrame:
    """`df` with `_block`: the block of its key that a row belongs to, 0 for keys that aren't hot."""
    marked = df.join(F.broadcast(hot), key, "left")
    return marked.withColumn("_block", F.when(F.col("_blocks").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(*by), F.col("_blocks")).cast("int"))).drop("_blocks")


def in_every_block(df: DataFrame, key: str, hot: DataFrame) -> DataFrame:
    """`df` with `_block`: each row once for each block of its key."""
    return df.join(F.broadcast(hot), key, "left").withColumn("_block", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_blocks"), F.lit(1)) - 1))).drop("_blocks")
