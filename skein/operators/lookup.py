"""Key, pattern and date lookups, counts, samples and keyset scans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions.prepare import date_string


def fold_meta(text: DataFrame, meta: DataFrame, fields: list[str]) -> DataFrame:
    """Text rows with their metadata; repeated metadata rows of a rowid count once (the least), rows without any are dropped."""
    once = meta.groupBy("rowid").agg(F.min(F.struct(*fields)).alias("_m")).select("rowid", *[F.col(f"_m.{f}").alias(f) for f in fields])
    return text.join(once, "rowid")


def first_wins(df: DataFrame, key: str, order: str, rows: DataFrame | None = None) -> DataFrame:
    """One row for each key, that of least `order` (unique in a key); rows without a key (null or empty) are dropped.

    Only keys and orders are aggregated, by hash and before the shuffle, so
    that a key of many rows is no hot task; the rows come by a semi-join, for
    which the planner may broadcast, and unused columns are never read.
    `rows` are the same rows otherwise partitioned, from which the result is
    taken.
    """
    valid = F.col(key).isNotNull() & (F.col(key) != "")
    first = df.where(valid).groupBy(key).agg(F.min(order).alias(order))
    return (df if rows is None else rows).where(valid).join(first, [key, order], "left_semi").select(*df.columns)


def between(df: DataFrame, column: str, low: int | None = None, high: int | None = None) -> DataFrame:
    """Rows within inclusive bounds; an absent bound adds no predicate."""
    if low is not None:
        df = df.where(F.col(column) >= low)
    return df if high is None else df.where(F.col(column) <= high)


def check_limit(limit: int) -> int:
    if limit < 0:
        raise ValueError("a limit is not negative")
    return limit


def by_date_range(messages: DataFrame, low: int, high: int, limit: int = 1000) -> DataFrame:
    """The newest messages of a period, both bounds needed and inclusive, with the date as text."""
    if low is None or high is None:
        raise ValueError("both bounds are needed")
    found = between(messages, "dateMs", low, high).select("rowid", "msgId", "subject", "dateMs")
    return found.withColumn("dateStr", date_string(F.col("dateMs"))).orderBy(F.desc("dateMs"), "rowid").limit(check_limit(limit))


def read_around(memory: DataFrame, at_ms: int, tolerance_ms: int = 600_000, limit: int = 50) -> DataFrame:
    """Entries around a time, oldest first."""
    if not at_ms:
        raise ValueError("a time is needed")
    return between(memory, "dateMs", at_ms - tolerance_ms, at_ms + tolerance_ms).orderBy("dateMs", "rowid").limit(check_limit(limit))


def newest(df: DataFrame, limit: int = 10) -> DataFrame:
    return df.orderBy(F.desc("dateMs"), "rowid").limit(check_limit(limit))


def by_key(df: DataFrame, key: str, value: str) -> DataFrame:
    """The row of a key, or none."""
    if value is None:
        raise ValueError("a key is needed")
    return df.where(F.col(key) == value).orderBy("rowid").limit(1)


def _like(account: str, header: str) -> str:
    return f"{account}:%:{header}".replace("\\", "\\\\")


def by_header(messages: DataFrame, account: str, header: str) -> DataFrame:
    """The ids `account:folder:header` of a mail in all its folders; % and _ in the arguments are wildcards, case plays no part."""
    return messages.where(F.col("msgId").ilike(_like(account, header))).select("msgId")


def keyset_batch(df: DataFrame, last_rowid: int = 0, size: int = 500) -> DataFrame:
    """The next rows after a rowid, in its order."""
    return df.where(F.col("rowid") > last_rowid).orderBy("rowid").limit(check_limit(size))


def without_keys(df: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """The rows whose key is not among those to be removed; rows without a key stay."""
    return df.join(gone.select(key).where(F.col(key).isNotNull() & (F.col(key) != "")).distinct(), key, "left_anti").select(*df.columns)


def not_in(incoming: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """Incoming rows whose non-empty key does not exist yet; their repetitions stay."""
    return incoming.where(F.col(key).isNotNull() & (F.col(key) != "")).join(existing.select(key).distinct(), key, "left_anti")


def counts(text: DataFrame, vectors: DataFrame | None, text_name: str = "docs", vector_name: str = "vecDocs") -> DataFrame:
    """One row with the number of texts and of vectors (0 without a vector table)."""
    docs = text.agg(F.count(F.lit(1)).alias(text_name))
    if vectors is None:
        return docs.withColumn(vector_name, F.lit(0).cast("long"))
    one: Column = F.lit(1)
    return docs.withColumn("_k", one).join(vectors.agg(F.count(one).alias(vector_name)).withColumn("_k", one), "_k").drop("_k")
