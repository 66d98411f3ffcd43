"""Rows of loosely typed JSON as typed DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

MESSAGE_SCHEMA = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("msgId", "subject", "from_", "to_", "cc", "bcc", "body")]
    + [T.StructField("dateMs", T.LongType()), T.StructField("hasAttachments", T.BooleanType()), T.StructField("parsedIcsAttachments", T.StringType())]
)
MEMORY_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in ("memId", "role", "content", "sessionId")] + [T.StructField("dateMs", T.LongType()), T.StructField("turnIndex", T.LongType())])
#: Other names of columns, tried in order when a text is missing or no text.
OTHER_NAMES = {"from_": ("from", "author"), "to_": ("to",)}


def coerce(row: dict, schema: T.StructType) -> tuple | None:
    """The typed row, or None without a non-empty text as key.

    Missing and wrongly typed values become '', 0 or false; whole numbers only
    count as numbers and booleans only as booleans. An empty text is a text.
    """
    key = row.get(schema.fields[0].name)
    if not isinstance(key, str) or not key:
        return None
    out = []
    for f in schema.fields:
        value = row.get(f.name)
        if isinstance(f.dataType, T.StringType):
            options = [value, *(row.get(n) for n in OTHER_NAMES.get(f.name, ()))]
            out.append(next((x for x in options if isinstance(x, str)), ""))
        elif isinstance(f.dataType, T.LongType):
            out.append(value if isinstance(value, int) and not isinstance(value, bool) and -(1 << 63) <= value < 1 << 63 else 0)
        else:
            out.append(value if isinstance(value, bool) else False)
    return tuple(out)


def from_rows(spark: SparkSession, rows: list[dict], schema: T.StructType) -> DataFrame:
    """A batch of rows in their order (`_pos`), without those that have no key."""
    typed = [(*t, i) for i, r in enumerate(rows) if (t := coerce(r, schema)) is not None]
    return spark.createDataFrame(typed, T.StructType([*schema.fields, T.StructField("_pos", T.LongType())]))
