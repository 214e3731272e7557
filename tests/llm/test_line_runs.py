"""The suffix array of lines at runs of 2 to 50 lines, and with a line that every document holds."""

import random

import pytest
from pyspark.sql import functions as F

from loam.llm.line_dedup import line_dedup, repeated_windows, sorted_groups, text_hashes


def corpus():
    rng = random.Random(8)
    line = lambda: "".join(rng.choice("abcdef") for _ in range(6))
    shared, texts = [line() for _ in range(50)], []
    for i in range(90):
        own = ["the same line", *(line() for _ in range(rng.randrange(6)))]
        n = rng.randrange(2, 51)
        at = rng.randrange(len(shared) - n + 1)
        own[rng.randrange(len(own) + 1) : 0] = shared[at : at + n] if i % 3 else []
        texts.append([*own, "the same line", "again"][: rng.randrange(2, 70)])
    texts += [["the same line"] * 9, ["again"], ["the same line", "again"], texts[7], texts[7]]
    return list(enumerate(texts))


def levels(least):
    out, h = [], 1
    while h < 128:
        h += least - h if h < least < 2 * h else h
        if h >= least:
            out.append(h)
    return out


@pytest.mark.parametrize("least", [2, 3, 7])
def test_longest_windows(spark, least):
    """The longest window of each suffix is the longest one of the rounds' lengths that an earlier suffix shares."""
    rows = corpus()
    docs = spark.createDataFrame([(i, "\n".join(t)) for i, t in rows], "doc_id long, text string").repartition(5)
    lines = docs.select("doc_id", F.xxhash64("text").alias("tag"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    a, b = text_hashes(F.col("line"))
    windows, _ = repeated_windows(lines.select(a.alias("a"), b.alias("b"), "doc_id", "tag", F.col("pos").cast("long").alias("pos"), F.lit(False).alias("long")), least)
    got = {(r["doc_id"], r["pos"]): r["n"] for r in windows.groupBy("doc_id", "pos").agg(F.max("n").alias("n")).collect()}
    want, seen = {}, set()
    for i, t in rows:
        for p in range(len(t)):
            fits = [h for h in levels(least) if p + h <= len(t) and tuple(t[p : p + h]) in seen]
            if fits:
                want[i, p] = max(fits)
            seen.update(tuple(t[p : p + h]) for h in levels(least) if p + h <= len(t))
    assert got == want


@pytest.mark.parametrize("least", [1, 2, 5, 20])
def test_runs_are_deleted(spark, least):
    rows = corpus()
    docs = spark.createDataFrame([(i, "\n".join(t)) for i, t in rows], "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: (r["text"], r["line_dedup"]["n_removed"]) for r in line_dedup(docs, min_lines=least).collect()}
    seen = set()
    for i, t in rows:
        gone = set()
        for p in range(len(t) - least + 1):
            if tuple(t[p : p + least]) in seen:
                gone |= set(range(p, p + least))
            seen.add(tuple(t[p : p + least]))
        assert got[i] == ("\n".join(x for p, x in enumerate(t) if p not in gone), len(gone))


def test_groups_across_partitions(spark):
    """One key in most rows lies in many partitions; starts and sizes are those of the whole table."""
    rng = random.Random(2)
    rows = [(rng.choice((1, 5, 5, 5, 5)), rng.choice((0, 3, 3, 3)), rng.choice((None, *range(40))), rng.randrange(3), rng.randrange(9)) for _ in range(700)]
    table, _ = sorted_groups(spark.createDataFrame(rows, "a long, b long, doc_id long, tag long, pos long").repartition(6))
    order = sorted(set(rows), key=lambda r: (r[0], r[1], r[2] is not None, r[2] or 0, r[3], r[4]))
    want = {(r, i, next(j for j, x in enumerate(order) if x[0] == r[0]), next(j for j, x in enumerate(order) if x[:2] == r[:2]), sum(x[:2] == r[:2] for x in order)) for i, r in enumerate(order)}
    assert {((r["a"], r["b"], r["doc_id"], r["tag"], r["pos"]), r["row"], r["start_a"], r["start_b"], r["n_b"]) for r in table.collect()} == want
