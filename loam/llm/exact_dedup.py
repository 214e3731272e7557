"""Exact dedup by a heavy-hitter split, in DataFrame functions only.

Every text is reduced to the SHA-256 of its normalised form. A mergeable Misra-Gries summary (Spark's
``approx_top_k``, the frequent-items sketch) names the few digests that may be frequent; one pass counts them
exactly, and those verified winners, at most ``heavy`` rows, are broadcast so that copies of a frequent text are
settled on the map side. Only the remaining digests are shuffled; any one of them holds a small share of the rows.

Defined results: a null text counts as empty; a null id is smaller than any other; of rows that repeat both id and
text exactly one stays; an empty table gives an empty result; further columns of the input are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Table, ascii_lower, body


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", heavy: int = 1000, counters: int = 10_000) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    heavy: how many digests may be broadcast; counters: size of the Misra-Gries summary. Both only steer the plan.
    """
    digest = F.sha2(ascii_lower(body(text_col)), 256)
    rows = Table(docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), digest.alias("sha")), "digests").df

    candidates = rows.agg(F.expr(f"approx_top_k(sha, {heavy}, {counters})").alias("top")).select(F.explode("top.item").alias("sha"))
    winner = [F.count(F.lit(1)).alias("group_size"), F.max(F.struct("doc_id", "row")).alias("keep")]
    verified = rows.join(F.broadcast(candidates), "sha").groupBy("sha").agg(*winner).filter("group_size > 1")
    verified = F.broadcast(Table(verified, "winners").df)

    frequent = rows.join(verified, "sha")
    rest = rows.join(verified.select("sha"), "sha", "left_anti")
    rest = rest.join(rest.groupBy("sha").agg(*winner), "sha")
    return frequent.unionByName(rest).select(
        "doc_id",
        F.col("keep.doc_id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("keep.row")).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )
