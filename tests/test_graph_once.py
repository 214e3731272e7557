"""The graph's tables from rows stored once."""

import pytest

from loam.operators import graph
from loam.operators.ingest import chunk_documents
from loam.plans import queries


@pytest.fixture(scope="module")
def parts(spark):
    text = " ".join(f"Sentence number {i} speaks of Anreon, with Thndor and Bcd here." for i in range(60))
    rows = [("d", "n", "A", text), ("d", "n", "B", "w" * 900), ("e", "n", "", "so Abc met Bcd. Or Cde alone, Def."), ("f", "n", "", None), ("g", "n", "", "  ")]
    return spark.createDataFrame(rows, "document_id string, document_name string, sheet_name string, text string")


@pytest.mark.parametrize("name", ["cooccurrence", "related_entities", "entity_nodes"])
def test_graph_reads_the_texts_once(spark, parts, tmp_path, name):
    parts.filter("sheet_name <> 'B'").selectExpr("document_id doc_id", "document_name source", "text").write.parquet(f"{tmp_path}/documents.parquet")
    plan = queries.QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "chunk_text" not in plan and "text#" not in plan


def test_relations_of_sentences(parts):
    got = {tuple(r) for r in graph.relation_rows(chunk_documents(parts, one_part=True)).collect()}
    assert ("e", "Abc", "met", "Bcd") in got and ("d", "Anreon", "with", "Thndor") not in got
    assert ("d", "Thndor", "and", "Bcd") in got and ("e", "Cde", "alone,", "Def") in got and not any(r[1:4:2] == ("Bcd", "Cde") for r in got)
