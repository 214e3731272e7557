"""A corpus pipeline: five stages over documents, each on the rows that the one before kept.

quality drops documents whose probability of a passing grade is below a half; lines deletes later copies of repeated line
runs and long lines, and the documents that are nothing else; near_copies keeps the document with the smallest id of each component
of near copies; mixture schedules documents so that no source is repeated more than twice as often as another and each
document is shown at least once; tokens encodes the texts.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.llm.bpe import encode
from loam.llm.common import Table, load, settle
from loam.llm.jaccard import keep_one
from loam.llm.line_dedup import line_dedup
from loam.llm.mixing import mix
from loam.llm.quality import keep_quality


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Grades: 0 low quality, 1 good but toxic, 2 good; a document passes with grade 1 or more."""
    settle(spark, executors=True)
    grades = load(spark, sf_dir, "labels").select("doc_id", (F.col("quality") * (2 - F.col("toxic"))).alias("grade"))
    return keep_quality(docs, grades, pass_grade=1, cut=0.5)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Runs of two lines or more, and lines of 50 words or more; n_chars follows the text. A text that loses all its lines goes."""
    settle(spark, executors=True)
    done = line_dedup(docs, min_lines=2, long_words=50).filter("line_dedup.n_removed < line_dedup.n_lines")
    changed = F.col("line_dedup.n_removed") > 0
    return done.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sets of five-word shingles with a Jaccard similarity of 0.8 or more."""
    settle(spark, executors=True)
    return keep_one(docs, k=5, similarity=(4, 5))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix(docs, repeat_limit=2.0).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, decoded_sha256: one row for each scheduled document."""
    settle(spark, executors=True)
    coded = encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), decoded=True)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("quality", quality), ("lines", lines), ("near_copies", near_copies), ("mixture", mixture), ("tokens", tokens)]

#: Shingle hashes, fitted weights and byte-pair merges have no SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order, applied to documents; each one's rows are written and read again."""
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = Table(stage(spark, docs, sf_dir), name).df
    return STAGES[-1][1](spark, docs, sf_dir)
