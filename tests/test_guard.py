"""The token guard before numbering, without a shuffle."""

import pytest

from loam.config import Settings
from loam.operators.ingest import chunk_documents, guarded


@pytest.fixture(scope="module")
def parts(spark):
    text = " ".join(f"Sentence number {i} speaks of Anreon, with Thndor and Bcd here." for i in range(60))
    rows = [("d", "n", "A", text), ("d", "n", "B", "w" * 900), ("e", "n", "", "so Abc met Bcd. Or Cde alone, Def."), ("f", "n", "", None), ("g", "n", "", "  ")]
    return spark.createDataFrame(rows, "document_id string, document_name string, sheet_name string, text string")


@pytest.mark.parametrize("one_part", [False, True])
def test_guard_before_numbering(parts, one_part):
    parts, conf = (parts.filter("sheet_name <> 'B'") if one_part else parts), Settings(chunk_tokens=40)
    got, want = chunk_documents(parts, conf, one_part, guard=True), guarded(chunk_documents(parts, conf, one_part), conf)
    of = lambda df: sorted(map(tuple, df.select("document_id", "sheet_name", "chunk_idx", "chunk_text").collect()))
    assert of(got) == of(want) and len(of(got)) > chunk_documents(parts, conf, one_part).count()
    if one_part:
        assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
