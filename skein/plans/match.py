"""Match trees as Column expressions, and BM25 ranks."""

from __future__ import annotations

import re
from dataclasses import dataclass
from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions.analysis import stemmed, tokens
from skein.functions.porter import stem
from skein.plans.query import And, Not, Or, Phrase, phrases

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6


@dataclass(frozen=True)
class Layout:
    """A text collection: key, text columns in order with their BM25 weights, snippet column (None: the best)."""

    key: str
    weights: dict[str, float]
    snippet: str | None = None

    @property
    def columns(self) -> list[str]:
        return list(self.weights)


#: The ranking weights of the two collections.
MESSAGES = Layout("msgId", {"msgId": 0.0, "subject": 5.0, "from_": 3.0, "to_": 2.0, "cc": 1.0, "bcc": 1.0, "body": 1.0})
MEMORY = Layout("memId", {"memId": 0.0, "role": 1.0, "content": 5.0, "sessionId": 0.0}, "content")


def analysed(df: DataFrame, layout: Layout, stems: bool = False) -> DataFrame:
    """`df` with a token array for each text column and the number of tokens in all of them."""
    make = (lambda c: stemmed(tokens(F.col(c)))) if stems else (lambda c: tokens(F.col(c)))
    df = df.withColumns({f"_t_{c}": make(c) for c in layout.columns})
    return df.withColumn("_length", sum((F.size(f"_t_{c}") for c in layout.columns[1:]), F.size(f"_t_{layout.columns[0]}")))


def _hits(phrase: Phrase, column: str) -> Column:
    """How often a phrase occurs in a token array."""
    array = F.col(f"_t_{column}")
    *exact, last = phrase.tokens
    ends = lambda x: x.startswith(last) if phrase.prefix else x == last
    if not exact:
        return F.size(F.filter(array, ends))
    # Each token between blanks of its own; a look-ahead counts overlapping occurrences.
    text = F.concat(F.lit(" "), F.array_join(array, "  "), F.lit(" "))
    words = "  ".join(map(re.escape, (*exact, last)))
    return F.regexp_count(text, F.lit(f"(?= {words}{'' if phrase.prefix else ' '})"))


def _columns(phrase: Phrase, layout: Layout) -> list[str]:
    return [phrase.column] if phrase.column else layout.columns


def evaluate(tree: object, matched: dict[Phrase, Column], live: Column) -> tuple[Column, list[tuple[Phrase, Column]]]:
    """Whether the tree matches, and each scoring phrase with the condition under which it counts.

    A phrase counts only where every AND and NOT above it matches; the right
    side of NOT never does.
    """
    if isinstance(tree, Phrase):
        return matched[tree], [(tree, live)]
    left, _ = evaluate(tree.left, matched, live)
    right, _ = evaluate(tree.right, matched, live)
    whole = left & right if isinstance(tree, And) else left | right if isinstance(tree, Or) else left & ~right
    inner = live if isinstance(tree, Or) else live & whole
    scored = evaluate(tree.left, matched, inner)[1]
    if not isinstance(tree, Not):
        scored += evaluate(tree.right, matched, inner)[1]
    return whole, scored


def stem_tree(tree: object) -> object:
    """The tree with stemmed terms; a prefix is stemmed before it is used as one."""
    if isinstance(tree, Phrase):
        return Phrase(tuple(map(stem, tree.tokens)), tree.prefix, tree.column)
    return type(tree)(stem_tree(tree.left), stem_tree(tree.right))


def ranked(df: DataFrame, tree: object, layout: Layout, stems: bool = False) -> DataFrame:
    """The matching rows of `df` with their BM25 `rank` (negative, less is better).

    The number of rows, the mean length and each phrase's row count are those
    of the whole of `df`: one aggregate of one row, read before the search is
    planned. Rows are then matched and scored by built-in expressions in one
    scan, without a shuffle.
    """
    tree = stem_tree(tree) if stems else tree
    every = list(dict.fromkeys(phrases(tree)))
    df = analysed(df, layout, stems)
    hits = {p: {c: f"_h{i}_{c}" for c in _columns(p, layout)} for i, p in enumerate(every)}
    df = df.withColumns({name: _hits(p, c) for p, by in hits.items() for c, name in by.items()})
    any_hit = {p: sum((F.col(n) for n in list(by.values())[1:]), F.col(next(iter(by.values())))) > 0 for p, by in hits.items()}
    counts = df.agg(F.count(F.lit(1)).alias("rows"), F.sum("_length").alias("length"), *[F.sum(any_hit[p].cast("long")).alias(f"n{i}") for i, p in enumerate(every)]).first()
    rows = counts["rows"]
    mean = (counts["length"] or 0) / rows if rows else 1.0
    whole, scored = evaluate(tree, any_hit, F.lit(True))
    rank = F.lit(0.0)
    for p, live in scored:
        n = counts[f"n{every.index(p)}"] or 0
        idf = log((rows - n + 0.5) / (n + 0.5)) if rows else 0.0
        weighted = sum((F.col(name) * layout.weights[c] for c, name in hits[p].items() if layout.weights[c]), F.lit(0.0))
        part = F.lit(max(idf, 0.0) or LEAST_IDF) * weighted * (K1 + 1) / (weighted + K1 * (1 - B + B * F.col("_length") / F.lit(mean or 1.0)))
        rank = rank - F.when(live, part).otherwise(0.0)
    kept = [c for c in df.columns if not c.startswith(("_t_", "_h")) and c != "_length"]
    return df.where(whole).select(*kept, rank.alias("rank"))
