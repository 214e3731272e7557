"""The index without a shuffle of postings, against the grouped postings."""

import pytest
from pyspark.sql import functions as F

from loam.operators import ingest
from loam.operators.index import Index
from loam.operators.ingest import collection_stats, postings, sorted_postings, text_stats

PARTS = "document_id string, document_name string, sheet_name string, text string"


@pytest.mark.parametrize("block", [1, 1 << 20])
def test_sorted_postings(spark, monkeypatch, block):
    monkeypatch.setattr(ingest, "BLOCK_BYTES", block)
    df = spark.createDataFrame([(f"d{i % 5}", i // 5, x) for i, x in enumerate(["a b a", "", None, "é b", "b", "a a a c", "zz é"])], "document_id string, chunk_idx int, w string")
    of = lambda x: sorted(map(tuple, x.select("document_id", "chunk_idx", "term", "tf", "dl").collect()))
    assert of(sorted_postings(df, "w")) == of(postings(df, "w"))
    assert text_stats(df, "w").collect() == collection_stats(postings(df, "w")).collect()
    assert [r["term"] for r in sorted_postings(df.coalesce(1), "w").collect()] == sorted(r["term"] for r in sorted_postings(df, "w").collect()) or block == 1


def build(spark, path, again):
    rows = [("d0" if again and i == 1 else f"d{i}", "n", "s", " ".join(f"word{i} and other{j} goes on and on." for j in range(60))) for i in range(3)]
    return Index(spark, str(path)).build(spark.createDataFrame(rows, PARTS), one_part=True)


def test_postings_are_not_shuffled(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("loam.operators.index.postings", None)
    index = build(spark, tmp_path, False)
    plan = sorted_postings(index.read("chunks"), "chunk_text_normalized")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan
    assert sorted(map(tuple, index.read("postings/content").collect())) == sorted(map(tuple, postings(index.read("chunks"), "chunk_text_normalized").collect()))


def test_ids_that_come_again_are_counted_together(spark, tmp_path):
    index = build(spark, tmp_path, True)
    one = index.read("postings/content")
    assert one.groupBy("document_id", "chunk_idx", "term").count().filter("count > 1").isEmpty()
    assert index.read("stats/content").first()["n"] == one.select("document_id", "chunk_idx").distinct().count()


def test_vectors_of_empty_and_null_lists(spark):
    df = spark.createDataFrame([(["a", "b", "a"],), ([],), (None,), (["c"],)], "w array<string>")
    got = [r["v"] for r in df.coalesce(1).select(ingest.HashEmbedder(8).column(F.col("w")).alias("v")).collect()]
    assert got[1] is None and got[2] is None
    assert sum(x * x for x in got[0]) == pytest.approx(1) and sorted(got[3])[-1] == 1.0 and len(got[3]) == 8
