"""Short extracts around the hits of a search, for result rows only."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions.analysis import tokens_py
from skein.plans.match import Layout
from skein.plans.query import Phrase, phrases

WINDOW = 16
_TOKEN = re.compile(r"(?:[^\W_]|[-_.@])+")


def _hits(words: list[str], phrase: Phrase) -> list[tuple[int, int]]:
    k = len(phrase.tokens)
    out = []
    for i in range(len(words) - k + 1):
        found = all(words[i + j] == t for j, t in enumerate(phrase.tokens[:-1]))
        last = words[i + k - 1]
        if found and (last.startswith(phrase.tokens[-1]) if phrase.prefix else last == phrase.tokens[-1]):
            out.append((i, i + k))
    return out


def best_window(text: str, wanted: list[Phrase], size: int = WINDOW) -> tuple[int, str]:
    """(score, extract) of the window with most different phrases, then most hits, hits in brackets and ellipses at cut sides."""
    spans = [m.span() for m in _TOKEN.finditer(text)]
    words = [(tokens_py(text[a:b]) or [""])[0] for a, b in spans]
    hits = sorted((a, b, n) for n, p in enumerate(wanted) for a, b in _hits(words, p))
    if not spans:
        return 0, text
    best, start = 0, 0
    for first, _, _ in hits:
        inside = [(a, b, n) for a, b, n in hits if first <= a and b <= first + size]
        score = 1000 * len({n for _, _, n in inside}) + len(inside) + (100 if first == 0 else 0)
        if score > best:
            best = score
            low, high = inside[0][0], max(b for _, b, _ in inside)
            start = max(0, min(low - (size - (high - low)) // 2, len(words) - size))
    end = min(start + size, len(words))
    out, at = [], spans[start][0] if start else 0
    covered = -1
    for a, b, _ in hits:
        if a >= start and b <= end and a > covered:
            out += [text[at : spans[a][0]], "[", text[spans[a][0] : spans[b - 1][1]], "]"]
            at, covered = spans[b - 1][1], b - 1
    out.append(text[at : spans[end - 1][1]] if end < len(words) else text[at:])
    return best, ("…" if start else "") + "".join(out) + ("…" if end < len(words) else "")


def with_snippets(rows: DataFrame, tree: object, layout: Layout) -> DataFrame:
    """Adds `snippet` from the layout's snippet column, or else from the column with the best window."""
    wanted = phrases(tree)
    columns = [layout.snippet] if layout.snippet else layout.columns

    @F.pandas_udf("string")
    def make(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for batch in batches:
            out = []
            for values in zip(*batch):
                tries = [best_window(v or "", [p for p in wanted if p.column in (None, c)]) for c, v in zip(columns, values)]
                out.append(max(tries, key=lambda t: t[0])[1])
            yield pd.Series(out, dtype=object)

    return rows.withColumn("snippet", make(*columns))
