"""Embedders: a protocol, and a deterministic one that needs no model."""

from __future__ import annotations

from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Embedder(Protocol):
    dim: int

    def batch(self, texts: list[str]) -> np.ndarray:
        """One unit row for each text."""


class ByteSumEmbedder:
    """Component i mod dim gathers byte i of the text; the sums are brought to length one."""

    def __init__(self, dim: int = 16):
        self.dim = dim

    def sums(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim), np.int64)
        for row, text in zip(out, texts, strict=True):
            data = np.frombuffer(text.encode(), np.uint8).astype(np.int64)
            row += np.pad(data, (0, -len(data) % self.dim)).reshape(-1, self.dim).sum(0)
        return out

    def batch(self, texts: list[str]) -> np.ndarray:
        return normalized(self.sums(texts).astype(np.float32))


def normalized(rows: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(length > 0, length, 1)


def mean_pool(states: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Unit means over the positions that the mask keeps: (batch, positions, dim) and (batch, positions)."""
    weight = mask[:, :, None].astype(states.dtype)
    return normalized((states * weight).sum(1) / np.maximum(weight.sum(1), 1e-9))


def to_bytes(vector: np.ndarray) -> bytes:
    return np.asarray(vector, "<f4").tobytes()


def from_bytes(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, "<f4")


def embed(df: DataFrame, text: Column, embedder: Embedder, alias: str = "embedding") -> DataFrame:
    @F.pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(list(embedder.batch(texts.fillna("").tolist())))

    return df.withColumn(alias, run(text))


def byte_sum_vector(text: Column, dim: int = 16) -> Column:
    """The byte-sum embedding as a native expression (for short texts)."""
    code = lambda i: F.conv(F.hex(F.substring(text.cast("binary"), i, F.lit(1))), 16, 10).cast("double")
    size = F.octet_length(text)
    sums = F.transform(F.sequence(F.lit(1), F.lit(dim)), lambda d: F.aggregate(F.filter(F.sequence(d, F.greatest(size, d), F.lit(dim)), lambda i: i <= size), F.lit(0.0), lambda s, i: s + code(i)))
    length = F.sqrt(F.aggregate(sums, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(sums, lambda x: F.when(length > 0, x / length).otherwise(F.lit(0.0)))
