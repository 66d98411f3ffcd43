"""Ranks inside groups of any size, without one task per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bins per doubling of a score. The bin is a closed form of the score alone, so that every pass agrees on it.
BINS_PER_OCTAVE = 1024


def _bin(score: Column) -> Column:
    """A monotone integer of a finite or infinite score."""
    magnitude = F.log2(F.least(F.greatest(F.abs(score), F.lit(1e-300)), F.lit(1e300))) + F.lit(1000.0)
    return F.signum(score).cast("long") * F.floor(magnitude * BINS_PER_OCTAVE)


def midranks(df: DataFrame, group: list[str], score: str, out: str = "rank", first: bool = False) -> DataFrame:
    """Adds `out`: the descending rank of `score` in its group, ties at their mean rank or, with `first`, at their first.

    Null and NaN scores get a null rank and do not count. The count of each
    distinct score is aggregated first; then a group's order is the order of
    its score bins plus the order inside each bin, so that a group holding most
    of the rows is still sorted by many tasks. A group has at most as many bins
    as the closed form has values, however many rows it holds.
    """
    present = df.where(F.col(score).isNotNull() & ~F.isnan(score))
    values = present.groupBy(*group, score).agg(F.count(F.lit(1)).alias("_n")).withColumn("_bin", _bin(F.col(score)))
    bins = values.groupBy(*group, "_bin").agg(F.sum("_n").alias("_in_bin"))
    over_bins = Window.partitionBy(*group).orderBy(F.desc("_bin")).rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.select(*group, "_bin", F.coalesce(F.sum("_in_bin").over(over_bins), F.lit(0)).alias("_above"))
    inside = Window.partitionBy(*group, "_bin").orderBy(F.desc(score)).rowsBetween(Window.unboundedPreceding, -1)
    ranked = (
        values.withColumn("_before", F.coalesce(F.sum("_n").over(inside), F.lit(0)))
        .join(bins, [*group, "_bin"])
        .select(*group, score, (F.col("_above") + F.col("_before") + (F.lit(1) if first else (F.col("_n") + 1) / 2)).alias(out))
    )
    return df.join(ranked, [*group, score], "left")
