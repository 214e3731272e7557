"""Edge cases: large and split SimHash buckets, vectors that take no part, ratings and tables that are null or empty."""

import math
import random

import numpy as np
import pytest

from loam.llm.graph import components
from loam.llm.quality import CumulativeLink, ordinal_quality
from loam.llm.queries import op6_topk
from loam.llm.simhash import links, simhash_components


def grouped(prints, radius):
    """Least member reachable by pairs of at most `radius` differing bits, as signed numbers."""
    root = {p: p for p in prints}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for i, a in enumerate(prints):
        for b in prints[:i]:
            if ((a ^ b) & (1 << 64) - 1).bit_count() <= radius:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {p: find(p) for p in prints}


@pytest.mark.parametrize("radius,split", [(1, 200_000), (2, 200_000), (3, 200_000), (2, 16), (3, 16)])
def test_links_of_large_buckets(spark, radius, split):
    """Some 200 fingerprints around one centre share most buckets; a small split deals these again."""
    rng = random.Random(radius)
    centre = rng.getrandbits(64)
    near = {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(6))) for _ in range(200)} | {rng.getrandbits(64) for _ in range(30)}
    prints = sorted(int(x) - (1 << 64 if x >> 63 else 0) for x in near)
    got = components(links(spark.createDataFrame([(p,) for p in prints], "fp long"), radius, split)).collect()
    found = {p: p for p in prints} | {r["node"]: r["root"] for r in got}
    assert found == grouped(prints, radius)


def test_texts_without_words_are_one_component(spark):
    rows = [(5, None), (3, ""), (9, " \t\n"), (4, "one two three four")]
    got = {r["doc_id"]: r for r in simhash_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i]["fingerprint"] for i in (5, 3, 9)] == ["0" * 16] * 3 and {got[i]["component_id"] for i in (5, 3, 9)} == {3}
    assert got[4]["component_id"] == 4


def test_vectors_that_take_no_part(spark, tmp_path):
    rng = np.random.default_rng(3)
    good = {i: [float(x) for x in rng.normal(size=4)] for i in (0, 1, 2, 3, 100, 101)}
    rows = [*good.items(), (1, good[1]), (200, None), (201, []), (300, [1.0, None, 0.0, 0.0]), (301, [math.nan, 0.0, 0.0, 0.0]), (302, [math.inf, 0.0, 0.0, 0.0]), (None, good[2])]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    whole = {i: [math.floor(1024 * x) for x in v] for i, v in good.items()}
    want = set()
    for q in (0, 100):
        scores = sorted((-sum(a * b for a, b in zip(whole[q], v)), i) for i, v in whole.items() if i != q)
        want |= {(q, n, i, -s) for n, (s, i) in enumerate(scores, 1)}
    assert {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in op6_topk(spark, str(tmp_path)).collect()} == want


def test_equal_scores_go_to_the_smaller_id(spark, tmp_path):
    spark.createDataFrame([(i, [1.0, 0.0]) for i in range(15)], "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = sorted((r["rank"], r["vec_id"]) for r in op6_topk(spark, str(tmp_path)).collect())
    assert got == [(n, n) for n in range(1, 11)]


def test_no_vectors(spark, tmp_path):
    spark.createDataFrame([], "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert op6_topk(spark, str(tmp_path)).count() == 0


def test_quality_with_null_and_repeated_rows(spark):
    """Every row gets a result, repeated rows the same one; null ratings and ids teach nothing."""
    docs = [(i, ("good clear prose here " if i % 2 else "junk spam click now ") * 5 + f"w{i}") for i in range(40)] + [(1, None), (None, "good clear"), (7, "good clear"), (7, "good clear")]
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    rated = [(i, 2 * (i % 2)) for i in range(30)]
    tail = lambda rows: sorted((str(r["doc_id"]), round(r["tail"], 6)) for r in ordinal_quality(docs, spark.createDataFrame(rows, "doc_id long, grade int")).collect())
    plain = tail(rated)
    assert len(plain) == 44 and tail([*rated, *rated, (31, None), (None, 0)]) == plain
    one = ordinal_quality(docs, spark.createDataFrame([], "doc_id long, grade int")).collect()
    assert len(one) == 44 and all(r["selected"] and r["expected_grade"] == 0 for r in one)
    assert ordinal_quality(docs.limit(0), spark.createDataFrame(rated, "doc_id long, grade int")).count() == 0


def test_quality_fit_lowers_the_loss():
    """The fitted model is better than the shares of the grades, and its thresholds are in order."""
    rng = np.random.default_rng(1)
    grade = rng.integers(0, 3, 600)
    slot = np.c_[grade, rng.integers(3, 16, 600)].ravel().astype(np.int32)
    model = CumulativeLink.fit(slot, np.ones(1200, np.float32), np.arange(0, 1201, 2), grade, bits=4)
    assert (np.diff(model.thresholds) > 0).all()
    s = np.add.reduceat(model.weights[slot], np.arange(0, 1200, 2))
    cum = np.c_[np.ones(600), model.tails(s), np.zeros(600)]
    loss = -np.log((cum[:, :-1] - cum[:, 1:])[np.arange(600), grade]).mean()
    share = np.bincount(grade) / 600
    assert loss < -(share * np.log(share)).sum()
    assert np.corrcoef(model.tails(s).sum(axis=1), grade)[0, 1] > 0.95
