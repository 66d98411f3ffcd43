"""Embedding texts by a pluggable model, in batches on the executors."""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Embedder(Protocol):
    name: str
    dims: int

    def embed(self, texts: list[str]) -> np.ndarray: ...


class HashingEmbedder:
    """Signed hashing of words and word pairs, of unit length; blank texts give zeros. Needs no model file."""

    def __init__(self, dims: int = 64):
        self.name, self.dims = f"hashing-{dims}", dims

    def embed(self, texts: list[str]) -> np.ndarray:
        import xxhash

        out = np.zeros((len(texts), self.dims), dtype=np.float32)
        for i, text in enumerate(texts):
            words = re.findall(r"\w+", text.lower())
            for item in (*words, *map(" ".join, zip(words, words[1:]))):
                h = xxhash.xxh3_64_intdigest(item)
                out[i, h % self.dims] += 1.0 if h >> 63 else -1.0
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


class LocalModelEmbedder:
    """A sentence model from a folder on every machine: tokenizer.json and model.onnx, mean-pooled to unit length.

    Loaded once a worker process, at the first batch; needs the packages
    `tokenizers` and `onnxruntime`.
    """

    def __init__(self, path: str, dims: int, most_tokens: int = 256):
        self.name, self.path, self.dims, self.most_tokens, self._parts = f"local-{dims}", path, dims, most_tokens, None

    def __getstate__(self) -> dict:
        return {**self.__dict__, "_parts": None}

    def embed(self, texts: list[str]) -> np.ndarray:
        if self._parts is None:
            import onnxruntime
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_file(f"{self.path}/tokenizer.json")
            tokenizer.enable_truncation(self.most_tokens)
            tokenizer.enable_padding()
            self._parts = tokenizer, onnxruntime.InferenceSession(f"{self.path}/model.onnx", providers=["CPUExecutionProvider"])
        tokenizer, model = self._parts
        if not texts:
            return np.zeros((0, self.dims), dtype=np.float32)
        coded = tokenizer.encode_batch(texts)
        mask = np.array([c.attention_mask for c in coded], dtype=np.int64)
        given = {"input_ids": np.array([c.ids for c in coded], dtype=np.int64), "attention_mask": mask, "token_type_ids": np.array([c.type_ids for c in coded], dtype=np.int64)}
        return mean_pool(model.run(None, {i.name: given[i.name] for i in model.get_inputs()})[0], mask).astype(np.float32)


def mean_pool(states: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """The unit mean of the token states that the mask keeps."""
    kept = mask[..., None].astype(np.float64)
    mean = (states * kept).sum(axis=1) / np.maximum(kept.sum(axis=1), 1e-9)
    return mean / np.maximum(np.linalg.norm(mean, axis=1, keepdims=True), 1e-12)


def embed(df: DataFrame, id_: str, text: str, embedder: Embedder, skip_failures: bool = False) -> DataFrame:
    """(id, embedding) of each row; null texts count as blank. A model that gives another length is an error.

    With `skip_failures` a batch on which the model fails goes through it text
    by text, and only the texts on which it fails again have no row.
    """
    schema = T.StructType([T.StructField(id_, df.schema[id_].dataType), T.StructField("embedding", T.ArrayType(T.FloatType()))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in batches:
            texts = [x or "" for x in t[text]]
            try:
                vectors = embedder.embed(texts)
            except Exception:
                if not skip_failures:
                    raise
                vectors, kept = [], []
                for i, x in enumerate(texts):
                    try:
                        vectors.append(embedder.embed([x])[0])
                        kept.append(i)
                    except Exception as e:
                        print(f"{embedder.name}: no vector for {t[id_].iloc[i]}: {e}", file=sys.stderr)
                t, vectors = t.iloc[kept], np.array(vectors, dtype=np.float32).reshape(len(kept), -1)
            if len(t) and vectors.shape[1] != embedder.dims:
                raise ValueError(f"{embedder.name} gave {vectors.shape[1]} numbers instead of {embedder.dims}")
            yield pd.DataFrame({id_: t[id_], "embedding": list(vectors.astype(np.float32))})

    return df.select(id_, text).mapInPandas(run, schema)


def embed_distinct(df: DataFrame, id_: str, text: str, embedder: Embedder) -> DataFrame:
    """Like `embed`, but each different text goes through the model once, however many rows have it."""
    keyed = df.select(id_, F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("_hash"), text)
    once = keyed.groupBy("_hash").agg(F.min(text).alias("_text"))
    return keyed.select(id_, "_hash").join(embed(once, "_hash", "_text", embedder), "_hash").select(id_, "embedding")
