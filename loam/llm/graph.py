"""Connected components of an edge table by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Table


def components(edges: DataFrame) -> DataFrame:
    """edges(a, b) of orderable ids -> (node, root) for every node that has an edge to another; root is the least node.

    Each round is written to the shared folder, so no lineage grows; no link or component reaches the driver.
    """

    def oriented(df: DataFrame) -> DataFrame:
        return df.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).filter("lo <> hi").distinct()

    def mark(table: Table) -> tuple:
        return tuple(table.df.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(lo, hi))")).first())

    now = Table(oriented(edges), "edges")
    seen = mark(now)
    while seen[0]:
        both = now.df.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(now.df.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("m").alias("lo"), F.col("v").alias("hi")).distinct()
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(least, "hi").filter("lo <> m").select(F.col("m").alias("a"), F.col("lo").alias("b"))
        new = Table(oriented(small.unionByName(least.select(F.col("m").alias("a"), F.col("hi").alias("b")))), "edges")
        now.drop()
        now, before, seen = new, seen, mark(new)
        if seen == before:
            break
    return now.df.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
