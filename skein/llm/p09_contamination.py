"""Evaluation passages inside corpus texts: winnowed fingerprints, joined and extended."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_WORD = re.compile(r"[^\W_]+")  # letters and digits, as marks are gone
_MARKS = regex.compile(r"\p{M}+")
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
#: Letters that no decomposition takes to their plain form (fixed values).
_PLAIN = {"ø": "o", "đ": "d", "ł": "l", "ħ": "h", "ı": "i", "æ": "ae", "œ": "oe"}


def plain_words(text: str | None) -> list[str]:
    """The longest runs of letters and digits, without regard to case and accents."""
    if not text:
        return []
    if not text.isascii():
        text = _MARKS.sub("", unicodedata.normalize("NFKD", text.casefold())).casefold()
        for letter, plain in _PLAIN.items():
            if letter in text:
                text = text.replace(letter, plain)
    else:
        text = text.lower()
    return _WORD.findall(text)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        import xxhash

        code = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "replace"))
        return code


class WordCodes:
    """Words to 64-bit hashes that are the same in every process; remembers a bounded number of words."""

    def __init__(self, remember: int = 500_000):
        self.known, self.remember = _Hashes(), remember

    def __call__(self, words: list[str]) -> np.ndarray:
        if len(self.known) > self.remember:
            self.known.clear()
        return np.fromiter(map(self.known.__getitem__, words), dtype=np.uint64, count=len(words))


def winnow(words: np.ndarray, k: int, window: int) -> np.ndarray:
    """The distinct fingerprints of a text: the least hash of k consecutive words in each window of `window` such hashes.

    Two texts that share k + window - 1 consecutive words share a fingerprint.
    A text with fewer hashes than a window has one window.
    """
    n = len(words) - k + 1
    if n < 1:
        return np.empty(0, dtype=np.uint64)
    h = np.zeros(n, dtype=np.uint64)
    for j in range(k):
        h = _mix(h * _GOLDEN + words[j : j + n])
    if n <= window:
        return h.min(keepdims=True)
    return np.unique(np.lib.stride_tricks.sliding_window_view(h, window).min(axis=1))


def winnow_all(texts: list[np.ndarray], k: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, fingerprint) of many texts at once, as `winnow` gives them; a fingerprint may be repeated."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    words = np.concatenate([np.empty(0, np.uint64), *texts])
    n = len(words) - k + 1
    if n < 1:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    owner = np.repeat(np.arange(len(texts)), sizes)
    h = np.zeros(n, dtype=np.uint64)
    for j in range(k):
        h = _mix(h * _GOLDEN + words[j : j + n])
    inside = owner[:n] == owner[k - 1 :]
    least = h.copy()
    last = np.arange(n)
    # the window that begins at each place, cut off at the text's end: texts with fewer hashes have one such window, the first
    for j in range(1, window):
        at = np.minimum(last + j, n - 1)
        whole = inside[at] & (owner[at] == owner[:n]) & (at == last + j)
        least = np.where(whole, np.minimum(least, h[at]), least)
    ends = np.cumsum(sizes) - k + 1  # behind each text's last hash
    full = inside & (last + window <= ends[owner[:n]])
    first = np.zeros(n, dtype=bool)
    begins = (np.cumsum(sizes) - sizes)[sizes >= k]
    first[begins] = True
    keep = full | (first & inside)
    keep[1:] &= ~(keep[:-1] & (least[1:] == least[:-1]) & (owner[1:n] == owner[: n - 1]))  # neighbours mostly have the same
    return owner[:n][keep], least[keep]


def longest_shared_run(a: np.ndarray, b: np.ndarray, k: int) -> int:
    """The most consecutive words that both texts have; hits of k words are extended along their diagonal."""
    if min(len(a), len(b)) < k:
        return 0

    def grams(x: np.ndarray) -> np.ndarray:
        h = np.zeros(len(x) - k + 1, dtype=np.uint64)
        for j in range(k):
            h = _mix(h * _GOLDEN + x[j : j + len(h)])
        return h

    ga, gb = grams(a), grams(b)
    order = np.argsort(gb, kind="stable")
    low, high = np.searchsorted(gb[order], ga, "left"), np.searchsorted(gb[order], ga, "right")
    best = 0
    run: dict[int, int] = {}
    for i in np.flatnonzero(high > low):
        here = {int(j): run.get(int(j) - 1, k - 1) + 1 if run else k for j in order[low[i] : high[i]]}
        if i and high[i - 1] <= low[i - 1]:
            here = dict.fromkeys(here, k)
        best = max(best, max(here.values()))
        run = here
    return best


def leaked(corpus: DataFrame, items: DataFrame, doc_id: str, item_id: str, text: str = "text", least_words: int = 12, k: int = 9) -> DataFrame:
    """(doc_id, item_id, words): the documents that have at least `least_words` consecutive words of an item, and how many at most.

    Fingerprints are winnowed with windows of least_words - k + 1 hashes, so
    that every shared passage of `least_words` words shares one. Corpus and
    item fingerprints are joined as tables (the planner broadcasts the items
    only below its size threshold), and the hits of each document and item are
    extended word by word for the exact length. Only documents with a hit are
    read again. Case, accents, punctuation and spacing play no part.

    Null and short texts give no rows; a repeated document or item gives each
    pair once; clashing or further columns are ignored.
    """
    if not 1 <= k <= least_words:
        raise ValueError("k lies between 1 and least_words")
    window = least_words - k + 1
    docs = corpus.where(F.col(doc_id).isNotNull() & F.col(text).isNotNull()).select(F.col(doc_id).alias("d"), F.col(text).alias("dt"))
    tests = items.where(F.col(item_id).isNotNull() & F.col(text).isNotNull()).select(F.col(item_id).alias("i"), F.col(text).alias("it"))

    def fingerprints(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codes = WordCodes()
        for t in batches:
            texts, ids = t.iloc[:, 1].tolist(), t.iloc[:, 0].to_numpy()
            at = 0
            while at < len(texts):  # stretches of about five million characters
                end, chars = at, 0
                while end < len(texts) and (end == at or chars + len(texts[end]) < 5_000_000):
                    chars += len(texts[end])
                    end += 1
                owner, found = winnow_all([codes(plain_words(x)) for x in texts[at:end]], k, window)
                yield pd.DataFrame({"id": ids[at:end][owner], "h": found.view(np.int64)})
                at = end

    kinds = docs.schema["d"].dataType.simpleString(), tests.schema["i"].dataType.simpleString()
    of_docs = docs.mapInPandas(fingerprints, f"id {kinds[0]}, h long").withColumnRenamed("id", "d")
    of_items = tests.mapInPandas(fingerprints, f"id {kinds[1]}, h long").withColumnRenamed("id", "i").distinct()
    hits = of_docs.join(of_items, "h").select("d", "i").distinct()

    @F.pandas_udf("int")
    def shared(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        codes = WordCodes()
        known: dict[str, np.ndarray] = {}
        last, words = None, np.empty(0, dtype=np.uint64)
        for a, b in batches:
            out = []
            for x, y in zip(a, b):
                if y not in known:
                    if len(known) > 1000:
                        known.clear()
                    known[y] = codes(plain_words(y))
                if x != last:  # the join leaves a document's rows together
                    last, words = x, codes(plain_words(x))
                out.append(longest_shared_run(words, known[y], k))
            yield pd.Series(out, dtype="int32")

    both = hits.join(docs, "d").join(tests, "i")
    return both.select(F.col("d").alias(doc_id), F.col("i").alias(item_id), shared("dt", "it").alias("words")).where(F.col("words") >= least_words).groupBy(doc_id, item_id).agg(F.max("words").alias("words"))
