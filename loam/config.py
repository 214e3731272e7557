"""Engine settings, read from the environment or from Spark configuration under the prefix loam."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Settings:
    chunk_size: int = 500
    chunk_overlap: int = 100
    chunk_tokens: int = 1800
    token_limit: int = 2048
    embedding_dim: int = 32
    embedding_batch: int = 25
    max_files: int = 5
    branch_top: int = 10
    name_top: int = 5
    graph_chunks: int = 10
    rewrite_queries: bool = True
    bm25_k1: float = 1.2
    bm25_b: float = 0.75
    rrf_constant: int = 60


def settings(spark: SparkSession | None = None) -> Settings:
    """Defaults, overridden by LOAM_<NAME> in the environment, then by loam.<name> in the session."""
    given = {}
    for f in fields(Settings):
        raw = os.environ.get(f"LOAM_{f.name.upper()}")
        if spark is not None:
            raw = spark.conf.get(f"loam.{f.name}", raw)
        if raw is not None:
            kind = type(f.default)
            given[f.name] = raw.lower() in ("1", "true", "yes") if kind is bool else kind(raw)
    return Settings(**given)
