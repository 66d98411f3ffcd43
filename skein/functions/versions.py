"""Comparison of dotted version numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _parts(version: Column) -> Column:
    """The numbers of a version's parts, however many; parts that are no numbers are dropped, and so are zeros at the end."""
    numbers = F.filter(F.transform(F.split(version, r"\."), lambda x: x.try_cast("long")), lambda x: x.isNotNull())
    backwards = F.reverse(numbers)
    zeros = F.aggregate(backwards, F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda a, x: F.struct((a["n"] + F.when(a["on"] & (x == 0), 1).otherwise(0)).alias("n"), (a["on"] & (x == 0)).alias("on")))["n"]
    return F.slice(numbers, F.lit(1), F.size(numbers) - zeros)


def version_less_than(a: Column, b: Column) -> Column:
    """Whether a is before b; missing parts count as 0. Of two arrays with a common beginning the shorter one is less."""
    return _parts(a) < _parts(b)
