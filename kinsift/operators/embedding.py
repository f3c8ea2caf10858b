"""Vectors of blocking keys. An embedder is a function from a text column to an array<float> column."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinsift.functions.columns import unit

Embedder = Callable[[Column], Column]


def hashed_embedder(buckets: int = 256, n: int = 3) -> Embedder:
    """Counts of letter n-grams by bucket, as hashed_ngrams has them; counted in Arrow batches, since an expression would look at every bucket for every gram."""
    @F.pandas_udf("array<float>")
    def embed(texts: pd.Series) -> pd.Series:
        known: dict[str, int] = {}

        def bucket(gram: str) -> int:
            if gram not in known:
                known[gram] = int(hashlib.md5(gram.encode("utf-8", "surrogatepass")).hexdigest()[:6], 16) % buckets
            return known[gram]

        def counts(text: str | None):
            low = (text or "").lower()
            hits = [bucket(low[k : k + n]) for k in range(max(len(low) - n + 1, 1))] if low else []
            return np.bincount(hits, minlength=buckets).astype(np.float32) if hits else np.zeros(buckets, np.float32)

        return pd.Series([counts(t) for t in texts])

    return embed


def batch_embedder(encode: Callable[[list[str]], list[list[float]]]) -> Embedder:
    """An embedder around any function from a batch of texts to vectors."""
    return model_embedder(lambda: encode)


def model_embedder(load: Callable[[], Callable[[list[str]], list[list[float]]]]) -> Embedder:
    """An embedder around a model: load() gives the function from a batch of texts to vectors, such as a sentence encoder's, and is called once in each task, not once a batch."""
    @F.pandas_udf("array<float>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = load()
        for texts in batches:
            yield pd.Series([list(map(float, v)) for v in encode(texts.fillna("").tolist())])

    return embed


def named_embedder(name: str) -> Embedder:
    """hashed, hashed:<buckets> or hashed:<buckets>:<n>, or <module>:<function>, where function() loads a model for model_embedder."""
    kind, *rest = name.split(":")
    if kind == "hashed":
        return hashed_embedder(*map(int, rest))
    if len(rest) != 1:
        raise ValueError(f"no such model: {name}")

    def load():
        import importlib

        return getattr(importlib.import_module(kind), rest[0])()

    return model_embedder(load)


def with_features(df: DataFrame, embedder: Embedder | None = None, key: str = "blockingKey") -> DataFrame:
    """features of the key and normFeatures at unit length."""
    embed = embedder or hashed_embedder()
    return df.withColumn("features", embed(F.col(key))).withColumn("normFeatures", unit(F.col("features")))


def l2_normalize(df: DataFrame, column: str = "features", to: str = "normFeatures") -> DataFrame:
    return df.withColumn(to, unit(F.col(column)))
