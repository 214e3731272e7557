"""The knowledge graph as node and edge tables."""

from __future__ import annotations

import ast
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx


@dataclass
class Graph:
    documents: DataFrame  # id, name
    chunks: DataFrame  # id, text
    entities: DataFrame  # id, name, type, document_id
    contains: DataFrame  # src, dst
    mentions: DataFrame  # src, dst
    relations: DataFrame  # src, dst, type


def read_triples(text: str | None) -> list[dict]:
    """Triples in a model's reply: a Python list of three-item lists or tuples of non-blank strings, or the first bracketed part."""
    value = literal(text)
    if value is None and (m := re.search(r"\[(.*?)\]", text or "", re.S)):
        value = literal(m[0])
    if not isinstance(value, list):
        return []
    rows = [x for x in value if isinstance(x, (list, tuple)) and len(x) == 3 and all(isinstance(y, str) and y.strip() for y in x)]
    return [dict(zip(("subj", "rel", "obj"), (y.strip() for y in x))) for x in rows]


def literal(text: str | None) -> object:
    try:
        return ast.literal_eval(text or "")
    except (ValueError, SyntaxError, MemoryError, RecursionError):
        return None


def parsed_triples(reply: str | Column) -> Column:
    """read_triples on a column of replies; replies are cleaned first."""
    of = F.pandas_udf(lambda s: s.map(read_triples), "array<struct<subj:string,rel:string,obj:string>>")
    return of(tx.cleaned_reply(F.col(reply) if isinstance(reply, str) else reply))


def rule_relations(sentence: Column, entities: Column) -> Column:
    """Default relation finder: neighbouring entities of a sentence, joined by the words between them."""
    between = lambda a, b: F.call_function("regexp_extract", sentence, F.concat(F.lit(r"\Q"), a, F.lit(r"\E\s+(.{1,60}?)\s+\Q"), b, F.lit(r"\E")), F.lit(1))
    pairs = F.transform(F.sequence(F.lit(1), F.size(entities) - 1), lambda i: F.struct(F.get(entities, i - 1).alias("subj"), between(F.get(entities, i - 1), F.get(entities, i)).alias("rel"), F.get(entities, i).alias("obj")))
    return F.when(F.size(entities) > 1, F.filter(pairs, lambda p: F.trim(p["rel"]) != "")).otherwise(F.array().cast("array<struct<subj:string,rel:string,obj:string>>"))


def chunk_id(doc: str | Column, idx: str | Column) -> Column:
    return F.concat(F.col(doc).cast("string") if isinstance(doc, str) else doc, F.lit("_chunk_"), F.col(idx).cast("string") if isinstance(idx, str) else idx)


def found_rows(chunks: DataFrame, most_chunks: int = 10) -> DataFrame:
    """(document_id, document_name, chunk_idx, names, triples) for the first chunks of each document: the entities of a chunk and
    the relations of its eligible sentences. No sentence holds entities that its chunk does not, so one entity gives no relations."""
    named = chunks.filter(F.col("chunk_idx") < most_chunks).select("document_id", "document_name", "chunk_idx", "chunk_text", tx.entities(F.col("chunk_text")).alias("names"))
    of = F.transform(tx.sentences(F.col("chunk_text")), lambda s: F.struct(s.alias("s"), tx.entities(s).alias("e")))
    of = F.filter(F.filter(of, lambda p: F.size(p["e"]) > 1), lambda p: tx.eligible_sentence(p["s"]))
    triples = F.flatten(F.transform(of, lambda p: rule_relations(p["s"], p["e"])))
    return named.select("document_id", "document_name", "chunk_idx", "names", F.when(F.size("names") > 1, triples).alias("triples"))


def mentions_of(found: DataFrame) -> DataFrame:
    return found.select("document_id", "chunk_idx", F.posexplode("names").alias("pos", "name"))


def relations_of(found: DataFrame) -> DataFrame:
    return found.select("document_id", F.explode("triples").alias("t")).select("document_id", "t.*").distinct()


def mention_rows(chunks: DataFrame, most_chunks: int = 10) -> DataFrame:
    """(document_id, chunk_idx, pos, name) for the first chunks of each document."""
    return mentions_of(found_rows(chunks, most_chunks))


def relation_rows(chunks: DataFrame, most_chunks: int = 10) -> DataFrame:
    """(document_id, subj, rel, obj), distinct, from eligible sentences of the first chunks."""
    return relations_of(found_rows(chunks, most_chunks))


def build_graph(chunks: DataFrame, most_chunks: int = 10, triples: DataFrame | None = None, found: DataFrame | None = None) -> Graph:
    """chunks(document_id, document_name, chunk_idx, chunk_text); triples(document_id, subj, rel, obj) instead of the default ones; found: found_rows of
    the chunks where those are stored, so that the tables are not each made from the texts.

    Entities belong to one document and keep the type of their first mention; ends of relations that no chunk mentions are added.
    """
    kept = chunks.filter(F.col("chunk_idx") < most_chunks)
    doc = F.col("document_id").cast("string")
    entity = lambda name: F.concat(doc, F.lit("_"), F.col(name))
    rows = found_rows(chunks, most_chunks) if found is None else found
    mentions = mentions_of(rows)
    triples = relations_of(rows) if triples is None else triples
    seen = mentions.select(entity("name").alias("id"), "name", F.lit("ENTITY").alias("type"), doc.alias("document_id"), F.lit(0).alias("o"))
    ends = triples.select(doc.alias("d"), F.explode(F.array("subj", "obj")).alias("name")).select(F.concat("d", F.lit("_"), "name").alias("id"), "name", F.lit("EXTRACTED").alias("type"), F.col("d").alias("document_id"), F.lit(1).alias("o"))
    nodes = seen.unionByName(ends).groupBy("id", "name", "document_id").agg(F.min_by("type", "o").alias("type"))
    return Graph(
        rows.groupBy(doc.alias("id")).agg(F.min("document_name").alias("name")),
        kept.select(chunk_id("document_id", "chunk_idx").alias("id"), F.col("chunk_text").alias("text")).dropDuplicates(["id"]),
        nodes.select("id", "name", "type", "document_id"),
        rows.select(doc.alias("src"), chunk_id("document_id", "chunk_idx").alias("dst")).distinct(),
        mentions.select(chunk_id("document_id", "chunk_idx").alias("src"), entity("name").alias("dst")).distinct(),
        triples.select(entity("subj").alias("src"), entity("obj").alias("dst"), F.col("rel").alias("type")).distinct(),
    )


def first_rows(df: DataFrame, top: int) -> DataFrame:
    w = Window.partitionBy("query_entity").orderBy("name", "document_id")
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)


def cooccurrence(g: Graph, names: DataFrame, top: int = 10) -> DataFrame:
    """names(query_entity) -> other entities of the documents that hold an entity of that name.

    Mentions are reduced to distinct entities of each document first, so no chunk pair is joined.
    """
    chunk_doc = g.contains.select(F.col("src").alias("doc"), F.col("dst").alias("chunk"))
    in_doc = g.mentions.join(chunk_doc, g.mentions["src"] == chunk_doc["chunk"]).select("doc", F.col("dst").alias("id")).distinct().join(g.entities.select("id", "name", "document_id"), "id")
    start = in_doc.join(names, in_doc["name"] == names["query_entity"]).select("query_entity", "doc", F.col("id").alias("start_id"))
    found = start.join(in_doc, "doc").filter(F.col("start_id") != F.col("id")).select("query_entity", "name", "document_id").distinct()
    label = F.concat("name", F.lit(" (из документа "), F.substring("document_id", 1, 8), F.lit("...)"))
    return first_rows(found, top).select("query_entity", "rank", "name", "document_id", label.alias("label"))


def related(g: Graph, names: DataFrame, top: int = 5) -> DataFrame:
    """names(query_entity) -> ends of the outgoing relations of entities of that name."""
    start = g.entities.join(names, g.entities["name"] == names["query_entity"]).select("query_entity", F.col("id").alias("src"))
    ends = g.entities.select(F.col("id").alias("dst"), "name", "document_id")
    found = start.join(g.relations, "src").join(ends, "dst").select("query_entity", "name", "document_id").distinct()
    label = F.concat("name", F.lit(" (связана с "), "query_entity", F.lit(")"))
    return first_rows(found, top).select("query_entity", "rank", "name", "document_id", label.alias("label"))


def related_labels(g: Graph, names: DataFrame) -> DataFrame:
    return cooccurrence(g, names).select("label").unionByName(related(g, names).select("label")).distinct()
