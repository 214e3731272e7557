"""Mixing sources to target weights by temperature, realised as budgeted block permutations.

A source with share p of all tokens gets weight p^a / sum p^a. The exponent a is bisected over [0, 1], thirty-two ways a
job, until the weights have the target entropy or until no source is repeated more than ``repeat_limit`` times as often as the
least repeated one; given both, the larger exponent holds. A budget of tokens (without one: the least that shows every document
once) is dealt by the weights. Each source is a shuffled sequence of blocks of documents; it gets whole epochs, each with a
permutation of its own, and of its last epoch the first blocks in that epoch's order, the last of them cut between documents.
Orders are MD5 values, so the schedule is the same wherever it is computed, and no source is sorted as a whole.

Defined results: a null source counts as the empty name; a null text has no tokens; texts without tokens follow their
block; a source without any tokens has weight 0 and is shown once, whatever the budget; rows that repeat an id are scheduled as
separate rows; an empty table gives an empty result; further columns stay as they are, whatever their names, but for `mix`.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Table, body, small_side


def words(text_col: str) -> Column:
    """Runs of non-blank characters, as a long."""
    return F.regexp_count(body(text_col), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def exponent(shares: DataFrame, target_entropy: float | None, repeat_limit: float | None, rounds: int = 8, ways: int = 32) -> float:
    """shares(p), positive and of sum 1 -> the exponent; 1 where nothing is asked for or a single source exists."""
    low, high, n = shares.agg(F.min("p"), F.max("p"), F.count(F.lit(1))).first()
    if not n or n == 1:
        return 1.0

    def bisect(meets) -> float:  # meets(grid) -> for each exponent whether it is too small
        lo, hi = 0.0, 1.0
        for _ in range(rounds):
            grid = [lo + (hi - lo) * i / ways for i in range(ways + 1)]
            small = meets(grid)
            if not small[0] and lo == 0.0:
                return 0.0
            k = max(i for i, x in enumerate(small) if x) if any(small) else 0
            if k == ways:
                return hi
            lo, hi = grid[k], grid[k + 1]
        return hi

    found = []
    if repeat_limit is not None:
        found.append(bisect(lambda grid: [(high / low) ** (1 - a) > repeat_limit for a in grid]))
    if target_entropy is not None:

        def too_flat(grid: list[float]) -> list[bool]:
            sums = shares.agg(*(x for a in grid for x in (F.sum(F.pow("p", F.lit(a))), F.sum(F.pow("p", F.lit(a)) * F.log("p"))))).first()
            return [math.log(z) - a * s / z > target_entropy for a, z, s in zip(grid, sums[::2], sums[1::2])]

        found.append(bisect(too_flat))
    return max(found, default=1.0)


def md5_int(*parts: Column | str) -> Column:
    """The first 8 hex digits of an MD5 as a long."""
    return F.conv(F.substring(md5_key(*parts), 1, 8), 16, 10).cast("long")


def md5_key(*parts: Column | str) -> Column:
    return F.md5(F.concat_ws(":", *(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts)).cast("binary"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", target_entropy: float | None = None, repeat_limit: float | None = 2.0, budget: int | None = None, block_tokens: int = 1_000_000, seed: str = "mix") -> DataFrame:
    """All columns of docs, one row for each scheduled copy, and mix: struct(source, weight, n_tokens, epoch, block, block_order, doc_order).

    Reading by (epoch, block_order, doc_order) within a source gives its sequence.
    """
    source = F.coalesce(F.col(source_col).cast("string"), F.lit(""))
    name = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    row = F.struct(source.alias("source"), words(text_col).alias("n_tokens"), md5_int(seed, name).alias("draw"), name.alias("name"))
    rows = docs.select(F.struct(*docs.columns).alias("row"), row.alias("mix"))  # packed, so that no name of docs meets one of ours
    slim = Table(rows.select("mix.*"), "mix").df
    sources = Table(slim.groupBy("source").agg(F.sum("n_tokens").alias("t")), "sources").df
    bare = sources.filter("t = 0")
    total = sources.agg(F.sum("t")).first()[0]
    if not total:
        total = 1
    shares = sources.filter("t > 0").select("source", "t", (F.col("t") / F.lit(float(total))).alias("p"))
    a = exponent(shares, target_entropy, repeat_limit)
    z = shares.agg(F.sum(F.pow("p", F.lit(a)))).first()[0] or 1.0
    weight = F.pow("p", F.lit(a)) / F.lit(z)
    tokens = float(budget) if budget is not None else shares.agg(F.max(F.col("t") / weight)).first()[0] or 0.0
    plan = shares.select("source", "t", weight.alias("weight"), F.round(weight * F.lit(tokens)).cast("long").alias("b"), F.ceil(F.col("t") / F.lit(float(block_tokens))).cast("long").alias("blocks"))
    plan = plan.withColumn("epochs", F.floor(F.col("b") / F.col("t")).cast("int")).withColumn("rest", F.col("b") - F.col("epochs") * F.col("t"))
    once = bare.selectExpr("source", "t", "0d AS weight", "0L AS b", "1L AS blocks", "0 AS epochs", "0L AS rest")  # its one block of no tokens is always read in full
    plan = Table(plan.unionByName(once), "plan").df
    plan = small_side(plan, plan.count(), 100_000)

    # the last epoch: which blocks are read in full, which one is cut
    placed = slim.join(plan, "source").withColumn("block", F.col("draw") % F.col("blocks"))
    blocks = placed.groupBy("source", "block").agg(F.sum("n_tokens").alias("size"), F.first("epochs").alias("epochs"), F.first("rest").alias("rest"))
    order = md5_key(seed, F.col("epochs"), F.col("source"), F.col("block"))
    before = F.sum("size").over(Window.partitionBy("source").orderBy(order, "block").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size")
    blocks = Table(blocks.withColumn("left", F.col("rest") - before).select("source", "block", "size", "left"), "blocks").df
    blocks = small_side(blocks, blocks.count(), 100_000)
    cut = placed.join(F.broadcast(blocks.filter("left > 0 and left < size")), ["source", "block"])  # one block a source
    upto = F.sum("n_tokens").over(Window.partitionBy("source").orderBy(md5_key(seed, F.col("epochs"), F.col("name")), "name").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    last = Table(cut.withColumn("upto", upto).filter("upto <= left").select("source", "name").distinct().withColumn("more", F.lit(1)), "cut").df
    last = small_side(last, last.count())

    out = rows.withColumns({"_source": F.col("mix.source"), "_name": F.col("mix.name")}).join(plan.select(F.col("source").alias("_source"), "weight", "epochs", "blocks"), "_source")
    out = out.withColumn("_block", F.col("mix.draw") % F.col("blocks")).join(blocks.select(F.col("source").alias("_source"), F.col("block").alias("_block"), "size", "left"), ["_source", "_block"])
    out = out.join(last.select(F.col("source").alias("_source"), F.col("name").alias("_name"), "more"), ["_source", "_name"], "left")
    copies = F.col("epochs") + F.when(F.col("left") >= F.col("size"), 1).when(F.col("left") > 0, F.coalesce("more", F.lit(0))).otherwise(0)
    out = out.withColumn("_copies", copies).filter("_copies > 0").withColumn("_epoch", F.explode(F.sequence(F.lit(0), F.col("_copies") - 1)))
    facts = F.struct(
        "mix.source",
        "weight",
        "mix.n_tokens",
        F.col("_epoch").alias("epoch"),
        F.col("_block").alias("block"),
        md5_key(seed, F.col("_epoch"), F.col("_source"), F.col("_block")).alias("block_order"),
        md5_key(seed, F.col("_epoch"), F.col("_name")).alias("doc_order"),
    )
    return out.select(*(F.col("row").getField(c).alias(c) for c in docs.columns if c != "mix"), facts.alias("mix"))
