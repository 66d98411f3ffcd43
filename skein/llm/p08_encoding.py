"""Encoding texts with a byte-level BPE vocabulary; merges are found by a segment tree."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: the pattern that cuts a text into pieces before merging; part of the vocabulary's definition.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
VOCABULARY = os.environ.get("SKEIN_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")
_NONE = 1 << 60


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to id; an id is also the token's merge rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def encode_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one piece by repeated merging of its leftmost pair of least rank.

    A segment tree over byte positions holds in each node the least
    (rank, position) below it, as one integer whose low bits are the position:
    the root names the next merge. A merge changes the pairs at two live
    positions and removes one, each a path of log n nodes, so that a piece of n
    bytes costs n log n however long it is.
    """
    n = len(piece)
    if n == 1:
        return [ranks[piece]]
    shift = n.bit_length()
    mask = (1 << shift) - 1
    size = 1 << (n - 1).bit_length()
    tree = [_NONE] * (2 * size)
    token = [piece[i : i + 1] for i in range(n)]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    for i in range(n - 1):
        r = ranks.get(piece[i : i + 2])
        if r is not None:
            tree[size + i] = r << shift | i
    for i in range(size - 1, 0, -1):
        a, b = tree[2 * i], tree[2 * i + 1]
        tree[i] = a if a < b else b

    def put(i: int, value: int) -> None:
        i += size
        tree[i] = value
        while i > 1:
            other = tree[i ^ 1]
            if other < value:
                value = other
            i >>= 1
            if tree[i] == value:
                break
            tree[i] = value

    def pair(i: int) -> int:
        j = after[i]
        if j >= n:
            return _NONE
        r = ranks.get(token[i] + token[j])
        return _NONE if r is None else r << shift | i

    while tree[1] != _NONE:
        i = tree[1] & mask
        j = after[i]
        token[i] += token[j]
        after[i] = k = after[j]
        if k < n:
            before[k] = i
        put(j, _NONE)
        put(i, pair(i))
        if before[i] >= 0:
            put(before[i], pair(before[i]))
    out, i = [], 0
    while i < n:
        out.append(ranks[token[i]])
        i = after[i]
    return out


class Encoder:
    """Encodes texts; pieces met before come from a memory of bounded size, which changes no result."""

    def __init__(self, path: str, remember: int = 200_000):
        self.ranks, self.pieces, self.known, self.remember = load_ranks(path), regex.compile(PIECES), {}, remember

    def __call__(self, text: str | None) -> list[int]:
        if not text:
            return []
        known, out = self.known, []
        for piece in self.pieces.findall(text):
            ids = known.get(piece)
            if ids is None:
                ids = encode_piece(piece.encode("utf-8", "replace"), self.ranks)
                if len(piece) <= 64:
                    if len(known) >= self.remember:
                        known.clear()
                    known[piece] = ids
            out += ids
        return out


def encode(df: DataFrame, text: str = "text", out: str = "ids", path: str = VOCABULARY) -> DataFrame:
    """Adds `out`, the token ids of `text` without special tokens; their strings are ordinary text.

    Null and empty texts give an empty list. Every row stays, one row each; no
    shuffle. `path` names the vocabulary as ranks, readable on every executor.
    """

    @F.pandas_udf("array<int>")
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = Encoder(path)
        for texts in batches:
            yield pd.Series([encoder(t) for t in texts])

    return df.withColumn(out, F.coalesce(ids(F.col(text)), F.array().cast("array<int>")))
