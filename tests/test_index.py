"""Numbering over sheets, the stored index against the tables it is made of, and deletion over all tables."""

import pytest

from loam.config import Settings
from loam.operators import catalog, graph, search
from loam.operators.index import Index
from loam.operators.ingest import chunk_documents, chunk_table, guarded

PARTS = "document_id string, document_name string, sheet_name string, part_idx int, text string"
LONG = " ".join(f"Sentence number {i} speaks of Anreon and Thndor here." for i in range(40))


@pytest.fixture(scope="module")
def parts(spark):
    rows = [("d", "book.xlsx", "B", 0, LONG), ("d", "book.xlsx", "A", 1, "Second sheet, by Anreon. " * 30), ("d", "book.xlsx", "C", 2, None), ("e", None, None, 0, "Prices rose while Thndor slept.")]
    return spark.createDataFrame(rows, PARTS)


def test_chunks_are_numbered_over_sheets(parts):
    got = [(r["document_id"], r["sheet_name"], r["chunk_idx"]) for r in chunk_documents(parts).orderBy("document_id", "chunk_idx").collect()]
    of_d = [x for x in got if x[0] == "d"]
    assert [x[2] for x in of_d] == list(range(len(of_d))) and len(set(x[1] for x in of_d)) == 2
    assert [x[1] for x in of_d] == sorted((x[1] for x in of_d), reverse=True)  # sheet B is part 0
    by_name = chunk_documents(parts.drop("part_idx")).orderBy("document_id", "chunk_idx").collect()
    assert [r["sheet_name"] for r in by_name if r["document_id"] == "d"][0] == "A"


def test_guarded_pieces_are_numbered_anew(parts):
    got = guarded(chunk_documents(parts), Settings(chunk_tokens=40)).orderBy("document_id", "chunk_idx").collect()
    assert [r["chunk_idx"] for r in got if r["document_id"] == "d"] == list(range(sum(r["document_id"] == "d" for r in got)))
    assert len(got) > chunk_documents(parts).count()


@pytest.mark.parametrize("ids", [None, ["d"], ["d", "e"]])
def test_index_gives_what_the_table_gives(spark, parts, tmp_path, ids):
    index = Index(spark, f"{tmp_path}/index").build(parts)
    q = spark.createDataFrame([(1, "prices rose"), (2, "number of Anreon"), (3, "sheet book xlsx"), (4, "qqqq")], "query_id int, query string")
    table = chunk_table(chunk_documents(parts))
    one, two = (sorted(map(tuple, search.hybrid(t, q, ids).collect())) for t in (table, index))
    assert one == two and one
    assert index.read("terms").count() > 10


def test_entity_weights_follow_the_question(spark, parts):
    """A question that names an entity takes the weights with entities, even if nothing holds it."""
    table, conf = chunk_table(chunk_documents(parts)), Settings()
    q = spark.createDataFrame([(1, "prices of Zqxwvk rose")], "query_id int, query string")
    found = search.branches(table, q, conf, search.HashEmbedder(conf.embedding_dim), True, True)
    assert {r["branch"] for r in found.collect()} == {"knn", "content"} and found.filter("not with_entity").count() == 0
    best = search.weighted_sum(found).orderBy("rank").first()
    assert best["score"] == pytest.approx(search.WEIGHTS_ENTITY["knn"] + search.WEIGHTS_ENTITY["content"])


def test_deletion_reaches_every_table(spark, parts, tmp_path):
    store = catalog.Store(spark, f"{tmp_path}/store")
    chunks = chunk_documents(parts)
    g = graph.build_graph(chunks, 99, spark.createDataFrame([("d", "Anreon", "met", "Thndor"), ("e", "Thndor", "saw", "Anreon")], "document_id string, subj string, rel string, obj string"))
    store.append("catalogue", spark.createDataFrame([("d", "book.xlsx"), ("e", "prices.txt")], "id string, file_name string"))
    for name, rows in (("chunks", chunks), ("entities", g.entities), ("mentions", g.mentions), ("contains", g.contains), ("relations", g.relations)):
        store.append(name, rows)
    before = {t: store.read(t).count() for t in store.tables()}
    assert len(before) == 6 and all(before.values())
    assert store.delete("book.xlsx") == 1
    assert [r["id"] for r in store.read("catalogue").collect()] == ["e"]
    for table, key, mark in (("chunks", "document_id", "e"), ("entities", "document_id", "e"), ("contains", "src", "e"), ("mentions", "src", "e_chunk_"), ("relations", "src", "e_")):
        rows = [r[key] for r in store.read(table).collect()]
        assert rows and all(x.startswith(mark) for x in rows), table
    with pytest.raises(catalog.NotFound):
        store.delete("book.xlsx")


def test_a_table_left_aside_comes_back(spark, tmp_path):
    store = catalog.Store(spark, f"{tmp_path}/store")
    store.append("_old_chunks", spark.range(3))
    assert store.exists("chunks") and store.read("chunks").count() == 3
