"""Pluggable model calls with deterministic defaults, since no model is at hand."""

from __future__ import annotations

import hashlib
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from credence.functions import text


class Embedder(Protocol):
    def __call__(self, texts: list[str]) -> np.ndarray: ...


class Classifier(Protocol):
    def __call__(self, text: str, names: list[str]) -> str | None: ...


class Judge(Protocol):
    def __call__(self, new: str, old: str, cosine: float) -> str: ...


class Summariser(Protocol):
    def __call__(self, texts: list[str]) -> str: ...


def hashing_embedder(dims: int = 64) -> Embedder:
    """Unit vectors of signed word counts."""

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dims), np.float32)
        for row, t in zip(out, texts):
            for word in (t or "").lower().split():
                h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
                row[h % dims] += 1 if h >> 63 else -1
        length = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(length == 0, 1, length)

    return embed


def embedding_column(embedder: Embedder, col: Column) -> Column:
    """Apply an embedder in Arrow batches."""
    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def run(s: pd.Series) -> pd.Series:
        return pd.Series(list(embedder(s.fillna("").tolist())))

    return run(col)


def rule_verdict(new: Column, old: Column, cos: Column, **floors: float) -> Column:
    """A judge by rules: contradicting records supersede, near ones are compatible."""
    return F.when(text.contradicts(new, old, cos, **floors), "supersedes").when(cos >= 0.9, "compatible").otherwise("extends")


def first_lines(texts: list[str], most: int = 5) -> str:
    """A summary by rule: the first sentences, joined."""
    return " | ".join(t.split(". ")[0][:120] for t in texts[:most])
