"""Interfaces of pluggable models, and deterministic stand-ins that need no service."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from .functions import text as tx


class Embedder(Protocol):
    dim: int

    def column(self, terms: Column) -> Column: ...


class TextGenerator(Protocol):
    def __call__(self, prompt: str) -> str: ...


class HashEmbedder:
    """Counts of terms in MD5 buckets, scaled to unit length; null where there are no terms."""

    def __init__(self, dim: int = 32):
        self.dim = dim

    def column(self, terms: Column) -> Column:
        dim = self.dim

        @F.arrow_udf("array<double>")
        def embed(lists: pa.Array) -> pa.Array:
            n, size = len(lists), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            words = lists.flatten().dictionary_encode()
            bucket = np.array([int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % dim for w in words.dictionary.to_pylist()], np.int64)
            at = np.repeat(np.arange(n) * dim, size) + bucket[words.indices.to_numpy(zero_copy_only=False)]
            counts = np.bincount(at, minlength=n * dim).reshape(n, dim)[size > 0].astype(float)
            unit = counts / np.sqrt((counts * counts).sum(axis=1, keepdims=True))
            ends = np.concatenate(([0], np.cumsum(np.where(size > 0, dim, 0)))).astype(np.int32)
            return pa.ListArray.from_arrays(pa.array(ends), pa.array(unit.ravel()), mask=pa.array(size == 0))

        return embed(terms)


def service_embedder(call: Callable[[list[str]], list[list[float]]], batch: int = 25, per_second: float | None = None) -> Callable[[Column], Column]:
    """A pandas UDF around an embedding service: batches, an optional rate limit for each partition, null on failure."""

    @F.pandas_udf("array<double>")
    def embed(texts: pd.Series) -> pd.Series:
        out: list[list[float] | None] = []
        for i in range(0, len(texts), batch):
            part = texts.iloc[i : i + batch].fillna("").tolist()
            if per_second:
                time.sleep(len(part) / per_second)
            try:
                out += call(part)
            except Exception:  # one bad text must not lose its neighbours
                for t in part:
                    try:
                        out += call([t])
                    except Exception:
                        out.append(None)
        return pd.Series(out)

    return embed


def overlap_reply(query: str, texts: list[str]) -> str:
    """Default reranker: places by the number of query words in each text, in the form that tx.reranked reads."""
    words = set(query.lower().split())
    order = sorted(range(len(texts)), key=lambda i: (-len(words & set(texts[i].lower().split())), i))
    return ", ".join(str(i + 1) for i in order)


class Extractive:
    """Default generator: the first context line of the prompt, or a fixed reply."""

    def __call__(self, prompt: str) -> str:
        lines = [x for x in prompt.split("\n") if x.startswith("[1] ")]
        return lines[0][4:] if lines else tx.NOT_FOUND[0]
