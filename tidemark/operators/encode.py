"""Encoding texts or frames with a model, and only what is not in the cache."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class HashingEncoder:
    """A stand-in for a model: signed counts of words hashed to ``dims`` places, at unit length."""

    def __init__(self, dims: int = 32):
        self.dims = dims

    def __call__(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dims))
        for row, text in zip(out, texts, strict=True):
            for w in re.findall(r"\w+", text.lower()):
                h = int.from_bytes(hashlib.md5(w.encode()).digest()[:8], "big")
                row[h % self.dims] += 1 if h >> 63 else -1
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def encode(df: DataFrame, column: str, make: Callable[[], Callable[[list], np.ndarray]], out: str = "emb", size: int = 64) -> DataFrame:
    """``df`` with unit vectors of ``column``. ``make`` builds the model, once per task; it gets ``size`` rows at a time."""
    schema = T.StructType([*df.schema, T.StructField(out, T.ArrayType(T.FloatType()))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for pdf in batches:
            made = [model(pdf[column].iloc[i : i + size].fillna("").tolist()) for i in range(0, len(pdf), size)]
            x = np.concatenate(made) if made else np.zeros((0, 1))
            x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
            yield pdf.assign(**{out: list(x.astype(np.float32))})

    return df.mapInPandas(run, schema)


def cache_key(*parts: Column | str) -> Column:
    """16 hex digits of the SHA-256 of the parts as JSON."""
    return F.substring(F.sha2(F.to_json(F.struct(*parts)), 256), 1, 16)


def missing(df: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    """Rows whose key the cache has not."""
    return df.join(cache.select(key), key, "left_anti")
