"""One ranking from several differently scaled scores, by robust rank aggregation."""

from __future__ import annotations

from functools import reduce
from math import comb

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.llm._ranks import midranks

#: The share of each list, from its top, in which a list supports an item.
SUPPORT = 0.4


def _power(x: Column, n: int) -> Column:
    return reduce(lambda a, b: a * b, [x] * n) if n else F.lit(1.0)


def order_statistic_probability(rank: Column, k: int, n: int) -> Column:
    """P(the k-th smallest of n uniform ranks is at most `rank`): the beta(k, n-k+1) distribution."""
    terms = [F.lit(float(comb(n, j))) * _power(rank, j) * _power(F.lit(1.0) - rank, n - j) for j in range(k, n + 1)]
    return reduce(lambda a, b: a + b, terms)


def aggregate_ranks(
    candidates: DataFrame,
    scores: list[str],
    group: str = "query_id",
    item: str = "rowid",
    absent: tuple[float, ...] = (0.0,),
    support: float = SUPPORT,
) -> DataFrame:
    """(group, item, supported, significance, mean_rank): the significance of each item's place in the lists.

    Each score becomes a normalised rank in its group (ties share the mean
    rank), so that its scale and spread have no influence. An item's sorted
    ranks r(1) <= ... <= r(n) are compared with those of n random lists: the
    significance is the least of the n beta probabilities of its order
    statistics times n (Bonferroni), at most 1. Small is significant.

    The minimum alone lets one excellent rank outweigh any other. `supported`
    therefore tells whether every list places the item in its best `support`
    (a share); supported items stand before all others in a ranking, and
    `support` = 1 gives the classical order.

    Null, NaN and the values in `absent` mean that a list lacks the item: rank
    1.0. Repeated rows count once (if they differ, the best of each score
    counts). Rows with a null group or item are dropped. An empty table gives
    an empty result. Further columns are ignored.
    """
    if not scores or not 0 < support <= 1:
        raise ValueError("at least one score, and a support above 0 and up to 1")
    n = len(scores)
    gone = lambda c: c.isNull() | F.isnan(c) | c.isin(*absent) if absent else c.isNull() | F.isnan(c)
    rows = (
        candidates.where(F.col(group).isNotNull() & F.col(item).isNotNull())
        .select(F.col(group).alias("_g"), F.col(item).alias("_i"), *[F.when(~gone(F.col(s).cast("double")), F.col(s).cast("double")).alias(f"_s{k}") for k, s in enumerate(scores)])
        .groupBy("_g", "_i")
        .agg(*[F.max(f"_s{k}").alias(f"_s{k}") for k in range(n)])
    )
    sizes = rows.groupBy("_g").agg(F.count(F.lit(1)).alias("_size"))
    long = rows.select("_g", "_i", F.explode(F.array(*[F.struct(F.lit(k).alias("l"), F.col(f"_s{k}").alias("s")) for k in range(n)])).alias("_x")).select("_g", "_i", F.col("_x.l").alias("_list"), F.col("_x.s").alias("_score"))
    ranked = midranks(long, ["_g", "_list"], "_score", "_rank").join(sizes, "_g")
    normal = F.coalesce(F.col("_rank") / F.col("_size"), F.lit(1.0))
    items = ranked.groupBy("_g", "_i").agg(F.array_sort(F.collect_list(normal)).alias("_r"), F.avg(normal).alias("mean_rank"))
    tests = [order_statistic_probability(F.col("_r")[k - 1], k, n) for k in range(1, n + 1)]
    least = F.least(*tests) if n > 1 else tests[0]
    return items.select(F.col("_g").alias(group), F.col("_i").alias(item), (F.col("_r")[n - 1] <= support).alias("supported"), F.least(F.lit(1.0), least * n).alias("significance"), "mean_rank")


def _order(item: str) -> list[Column]:
    return [F.desc("supported"), F.asc("significance"), F.asc("mean_rank"), F.asc(item)]


def top_places(ranked: DataFrame, wanted: DataFrame, group: str = "query_id", item: str = "rowid", places: str = "top_n") -> DataFrame:
    """The first places of each group's ranking, as many as `wanted` (group, places) says, with their `position` from 1.

    The largest number wanted bounds the rows a task keeps of one group, before
    the shuffle already, so that a group of any size is no hot task. Groups
    that `wanted` lacks, or with a null or no positive number, give no rows.
    """
    wanted = wanted.select(F.col(group), F.col(places).alias("_places")).where(F.col("_places") > 0).groupBy(group).agg(F.max("_places").alias("_places"))
    most = wanted.agg(F.max("_places")).first()[0] or 0
    place = F.row_number().over(Window.partitionBy(group).orderBy(*_order(item)))
    return ranked.withColumn("position", place).where(F.col("position") <= most).join(wanted, group).where(F.col("position") <= F.col("_places")).drop("_places")


def full_ranking(ranked: DataFrame, group: str = "query_id", item: str = "rowid") -> DataFrame:
    """Every item with its `position` from 1 in its group; groups of any size are sorted by many tasks.

    Supported items first, then the order of significance, then of mean rank
    among equals, then of id. Numeric ids are ranked like scores, so that even
    a group of equals is no hot task; ids of another type are sorted by one
    task a group of equals.
    """
    before = ranked.groupBy(group).agg(F.sum(F.col("supported").cast("long")).alias("_first"))
    keyed = ranked.join(before, group).withColumns({"_s": -F.col("significance"), "_m": -F.col("mean_rank"), "_first": F.when(F.col("supported"), F.lit(0)).otherwise(F.col("_first"))})
    placed = midranks(midranks(keyed, [group, "supported"], "_s", "_a", first=True), [group, "supported", "_s"], "_m", "_b", first=True)
    equal = [group, "supported", "_s", "_m"]
    if isinstance(ranked.schema[item].dataType, T.IntegralType):
        placed = midranks(placed.withColumn("_id", -F.col(item)), equal, "_id", "_c", first=True)
    else:
        placed = placed.withColumn("_c", F.row_number().over(Window.partitionBy(*equal).orderBy(F.asc(item))))
    return placed.withColumn("position", (F.col("_first") + F.col("_a") + F.col("_b") + F.col("_c") - 2).cast("long")).select(group, item, "supported", "significance", "mean_rank", "position")
