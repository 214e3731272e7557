"""Operators of the engine on small inputs."""

import io
import zipfile

import pytest

from loam.config import Settings
from loam.operators import catalog, chat, graph, search
from loam.operators.ingest import chunk_documents, chunk_table
from loam.sources import files


@pytest.fixture(scope="module")
def parts(spark):
    rows = [("d1", "report.pdf", None, "The town of Anreon met Thnd. It was large."), ("d2", None, "Sheet", "Prices rose while Anreon slept. Nothing else."), ("d3", "empty", None, None)]
    return spark.createDataFrame(rows, "document_id string, document_name string, sheet_name string, text string")


def test_chunks_and_search(spark, parts):
    table = chunk_table(chunk_documents(parts))
    assert {r["document_id"] for r in table.collect()} == {"d1", "d2"}
    q = spark.createDataFrame([(1, "prices rose"), (2, "qqqq")], "query_id int, query string")
    hits = search.hybrid(table, q).orderBy("query_id", "rank").collect()
    assert hits[0]["document_id"] == "d2" and hits[0]["score"] == 1.0
    assert [h["score"] for h in hits if h["query_id"] == 2] == [1.0, 0.9]  # the dense branch always finds something
    assert {h["document_id"] for h in search.hybrid(table, q, ["d1"]).collect()} == {"d1"}


def test_sources_keep_the_first_score(spark):
    hits = spark.createDataFrame([(1, "d1", 0.7, 1), (1, "d2", 1.0, 2), (1, "d1", 0.9, 3)], "query_id int, document_id string, score double, rank int")
    docs = spark.createDataFrame([("d1", "a")], "document_id string, document_name string")
    got = [(r["document_id"], r["confidence_score"], r["document_name"]) for r in search.sources(hits, docs).orderBy("rank").collect()]
    assert got == [("d1", 0.7, "a"), ("d2", 1.0, "Неизвестный документ")]


def test_graph(spark):
    chunks = spark.createDataFrame([("D", "n", 0, "so Abc and then Bcd"), ("D", "n", 1, "or, Cde")], "document_id string, document_name string, chunk_idx int, chunk_text string")
    triples = spark.createDataFrame([("D", "Abc", "knows", "Bcd")], "document_id string, subj string, rel string, obj string")
    g = graph.build_graph(chunks, triples=triples)
    names = spark.createDataFrame([("Abc",), ("Bcd",)], "query_entity string")
    near = {(r["query_entity"], r["name"]) for r in graph.cooccurrence(g, names).collect()}
    assert near == {("Abc", "Bcd"), ("Abc", "Cde"), ("Bcd", "Abc"), ("Bcd", "Cde")}
    assert [(r["query_entity"], r["name"]) for r in graph.related(g, names).collect()] == [("Abc", "Bcd")]


@pytest.mark.parametrize("reply,n", [("[('A','r','B')]", 1), ("Here: [('A','r','B')] done", 1), ("[['A','r','B']]", 1), ("('A','r','B')", 0), ("[('A','r')]", 0), ("[('A',' ','B')]", 0), ("[]", 0), (None, 0)])
def test_triples(spark, reply, n):
    got = spark.createDataFrame([(reply,)], "r string").select(graph.parsed_triples("r").alias("t")).first()["t"]
    assert len(got) == n


def test_store(spark, tmp_path):
    store = catalog.Store(spark, str(tmp_path))
    store.append("catalogue", spark.createDataFrame([("1", "a"), ("2", "a"), ("3", "b")], "id string, file_name string"))
    store.append("chunks", spark.createDataFrame([("1", "x"), ("3", "y")], "document_id string, chunk_text string"))
    with pytest.raises(catalog.NotFound):
        store.delete("zz")
    assert store.delete("a") == 2
    assert [r["document_id"] for r in store.read("chunks").collect()] == ["3"]
    assert store.delete() == 1 and store.read("catalogue").count() == 0


def test_workbook_and_html():
    book = io.BytesIO()
    with zipfile.ZipFile(book, "w") as z:
        ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
        z.writestr("xl/workbook.xml", f'<workbook {ns}><sheets><sheet name="S" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/s.xml"/></Relationships>')
        z.writestr("xl/worksheets/s.xml", f'<worksheet {ns}><sheetData><row><c r="A1" t="inlineStr"><is><t>k</t></is></c><c r="C1"><v>2</v></c></row><row><c r="A2"><v>3</v></c></row></sheetData></worksheet>')
    assert files.parts(book.getvalue(), "t.xlsx", "") == [("# S\n\n| k |  | 2 |\n| --- | --- | --- |\n| 3 |  |  |", "S")]
    page = b"<html><head><title>x</title></head><body><p>Hi&amp;lo</p><table><tr><th>a</th></tr><tr><td>1</td></tr></table><script>z</script></body></html>"
    assert files.parts(page, "p.html", "text/html") == [("Hi&lo\n\n| a |\n\n| --- |\n\n| 1 |", None)]


def test_chat(spark, parts):
    docs = parts.select("document_id", "document_name").fillna("unnamed")
    table = chunk_table(chunk_documents(parts))
    got = chat.chat(spark, table, docs, "prices rose")
    assert "Prices" in got.answer and got.sources[0]["document_id"] == "d2" and len(got.history) == 2
    assert chat.chat(spark, None, docs, "x").sources == []


def test_settings(monkeypatch):
    monkeypatch.setenv("LOAM_CHUNK_SIZE", "7")
    from loam.config import settings

    assert settings().chunk_size == 7 and Settings().chunk_size == 500


def test_entry_has_the_queries():
    import __spark_entry__

    assert "hybrid_rrf" in __spark_entry__.queries() and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
