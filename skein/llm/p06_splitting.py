"""Splitting oversized texts at natural boundaries, by a recursive separator hierarchy."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: From the coarsest to the finest: a unit ends where the match ends.
SEPARATORS = [
    re.compile(r"(?:\r?\n[ \t]*){3,}|\r?\n(?=#{1,6} )|\r?\n[-=_*]{3,}[ \t]*\r?\n"),  # sections
    re.compile(r"\r?\n[ \t]*\r?\n"),  # paragraphs
    re.compile(r"(?<![.!?…。！？])[.!?…。！？]++[\"'”’»)\]]*+\s+|\r?\n|[。！？]"),  # sentences and lines
    re.compile(r"\s+"),  # words
]
_WORD = re.compile(r"\s+")
#: Characters of pieces that are sent back at a time.
STRETCH = 5_000_000


def _units(text: str, start: int, end: int, limit: int, level: int = 0) -> Iterator[int]:
    """The ends of units of at most `limit` characters that tile text[start:end]."""
    if end - start <= limit:
        yield end
        return
    if level == len(SEPARATORS):
        while end - start > limit:
            cut = start + limit
            if text[cut - 1] == "\r" and text[cut] == "\n":
                cut -= 1
            yield cut
            start = cut
        yield end
        return
    at = start
    for m in SEPARATORS[level].finditer(text, start, end):
        if at < m.end() < end:
            yield from _units(text, at, m.end(), limit, level + 1)
            at = m.end()
    yield from _units(text, at, end, limit, level + 1)


def split_spans(text: str, limit: int, overlap: int) -> list[tuple[int, int]]:
    """(start, end) of the pieces of `text`: at most `limit` characters, neighbours sharing `overlap` or, up to the next word, fewer."""
    n = len(text)
    if n <= limit:
        return [(0, n)]
    out, start, last = [], 0, 0
    for unit in _units(text, 0, n, limit - overlap):
        if unit - start > limit:
            out.append((start, last))
            start = max(0, last - overlap)
            if start and not text[start - 1].isspace():
                m = _WORD.search(text, start, last)
                if m and m.end() < last:
                    start = m.end()
        last = unit
    out.append((start, n))
    return out


def split_texts(df: DataFrame, text: str, keys: list[str], limit: int = 2000, overlap: int = 200) -> DataFrame:
    """(keys, piece_no, start, end, piece): each text cut into pieces of at most `limit` characters.

    Cuts are sought at section ends, then paragraph ends, then sentence or line
    ends, then between words and only then between characters (never inside a
    CR LF); units are packed greedily. A piece begins `overlap` characters
    before the end of the one before, or at the first word after that point.
    Joining the pieces without their overlaps gives the text back exactly.

    A text within the limit is one piece and never leaves the JVM; an empty
    text is one empty piece; a null text gives no row. Longer ones are cut in
    Python, in time in proportion to their length.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap lies between 0 and limit")
    rows = df.select(*keys, F.col(text).alias("_text")).where(F.col("_text").isNotNull())
    schema = T.StructType([*rows.schema.fields[:-1], *(T.StructField(n, T.IntegerType()) for n in ("piece_no", "start", "end")), T.StructField("piece", T.StringType())])

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in batches:
            out: list[tuple] = []
            held = 0
            for *own, whole in t.itertuples(index=False, name=None):
                for i, (a, b) in enumerate(split_spans(whole, limit, overlap)):
                    out.append((*own, i, a, b, whole[a:b]))
                    held += b - a
                    if held > STRETCH:
                        yield pd.DataFrame(out, columns=schema.names)
                        out, held = [], 0
            if out:
                yield pd.DataFrame(out, columns=schema.names)

    long = F.char_length("_text") > limit
    short = rows.where(~long).select(*keys, F.lit(0).alias("piece_no"), F.lit(0).alias("start"), F.char_length("_text").alias("end"), F.col("_text").alias("piece"))
    return rows.where(long).mapInPandas(cut, schema).unionByName(short)
