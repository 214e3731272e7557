"""Dense and full-text retrieval, fusion, and sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Settings
from ..functions import text as tx
from ..models import Embedder, HashEmbedder
from .index import FIELDS, Index
from .ingest import CHUNK_KEY, collection_stats, postings

#: Weights of the branches of the multi-document strategy, without and with entities in the query.
WEIGHTS = {"knn": 0.4, "content": 0.3, "name": 0.15, "sheet": 0.15}
WEIGHTS_ENTITY = {"knn": 0.35, "content": 0.25, "name": 0.1, "sheet": 0.1, "entity": 0.2}
#: Fixed value: the name of a source whose document is not known.
UNKNOWN = "Неизвестный документ"


def best(scored: DataFrame, top: int, by: tuple[str, ...] = ("query_id",), key: tuple[str, ...] = CHUNK_KEY) -> DataFrame:
    """The `top` rows of each group with their rank, ties by key; window group limits keep the shuffle small."""
    w = Window.partitionBy(*by).orderBy(F.desc("score"), *key)
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)


def knn(table: DataFrame, queries: DataFrame, top: int, key: tuple[str, ...] = CHUNK_KEY, dims: str = "embedding") -> DataFrame:
    """queries(query_id, vector), a handful -> (query_id, key, score, rank) by cosine; rows without a vector are left out."""
    rows = table.filter(F.col(dims).isNotNull()).select(*key, dims, tx.norm(F.col(dims)).alias("_norm"))
    pairs = rows.crossJoin(F.broadcast(queries.select("query_id", "vector", tx.norm(F.col("vector")).alias("_asked"))))
    cosine = tx.dot(F.col(dims), F.col("vector")) / F.nullif(F.col("_norm") * F.col("_asked"), F.lit(0.0))
    scored = pairs.select("query_id", *key, F.round(cosine, 6).alias("score")).filter("score is not null")
    return best(scored, top, key=key)


def bm25(index: DataFrame, queries: DataFrame, top: int, conf: Settings = Settings(), key: tuple[str, ...] = CHUNK_KEY, stats: DataFrame | None = None) -> DataFrame:
    """queries(query_id, term) distinct, a handful -> (query_id, key, score, rank). Only postings of query terms are joined; stats(n, avgdl) as stored, or of the postings."""
    terms = F.broadcast(queries.select("term").distinct())
    hits = index.join(terms, "term")
    df = hits.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    stats = collection_stats(index, key) if stats is None else stats
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (conf.bm25_k1 + 1) / (F.col("tf") + conf.bm25_k1 * (1 - conf.bm25_b + conf.bm25_b * F.col("dl") / F.col("avgdl")))
    weighted = hits.join(F.broadcast(df), "term").crossJoin(F.broadcast(stats)).select(*key, "term", weight.alias("w"))
    scored = weighted.join(F.broadcast(queries), "term").groupBy("query_id", *key).agg(F.round(F.sum("w"), 6).alias("score"))
    return best(scored, top, key=key)


def query_terms(queries: DataFrame, terms: Column) -> DataFrame:
    return queries.select("query_id", F.explode(F.array_distinct(terms)).alias("term"))


def branches(table: DataFrame | Index, queries: DataFrame, conf: Settings, embedder: Embedder, multi: bool, sheets: bool, document_ids: list | None = None) -> DataFrame:
    """All branches of the strategy for queries(query_id, query): (query_id, branch, key, score, rank, with_entity).

    table: chunks, from which postings are made, or the stored index, of which only the rows of the queries' terms are read.
    with_entity: whether the query names an entity, whatever is found.
    """
    chunks = table.chunks(document_ids) if isinstance(table, Index) else table

    def text(field: str, asked: DataFrame, top: int) -> DataFrame:
        if not isinstance(table, Index):
            return bm25(postings(table, FIELDS[field]), asked, top, conf)
        index, stats = table.field(field, [r["term"] for r in asked.select("term").distinct().collect()], document_ids)  # a handful
        return bm25(index, asked, top, conf, stats=stats)

    q = query_terms(queries, tx.terms(F.col("query")))
    names = query_terms(queries, tx.name_terms(F.col("query")))
    vectors = queries.select("query_id", embedder.column(tx.terms(F.col("query"))).alias("vector")).filter("vector is not null")
    found = {"knn": knn(chunks, vectors, conf.branch_top), "content": text("content", q, conf.branch_top)}
    if multi:
        found["name"] = text("name", names, conf.name_top)
    if multi or sheets:
        found["sheet"] = text("sheet", names, conf.name_top if multi else conf.branch_top)
    entities = queries.select("query_id", F.explode(tx.entities(F.col("query"))).alias("entity")).select("query_id", F.lower("entity").alias("term")).distinct()
    found["entity"] = text("content", entities, conf.name_top)
    out = None
    for name, df in found.items():
        df = df.select("query_id", F.lit(name).alias("branch"), *CHUNK_KEY, "score", "rank")
        out = df if out is None else out.unionByName(df)
    named = queries.select("query_id", (F.size(tx.entities(F.col("query"))) > 0).alias("with_entity"))
    return out.join(F.broadcast(named), "query_id")


def rrf(found: DataFrame, constant: int = 60, top: int = 10) -> DataFrame:
    """Reciprocal rank fusion, independent of the order of branches."""
    score = F.round(F.sum(1 / (F.lit(float(constant)) + F.col("rank"))), 9)
    return best(found.groupBy("query_id", *CHUNK_KEY).agg(score.alias("score")), top)


def weighted_sum(found: DataFrame, top: int = 10) -> DataFrame:
    """Sum of weights times scores scaled to 0..1 within each branch (1 where all are equal); a missing branch adds 0."""
    w = Window.partitionBy("query_id", "branch")
    low, high = F.min("score").over(w), F.max("score").over(w)
    scaled = F.when(high > low, (F.col("score") - low) / (high - low)).otherwise(F.lit(1.0))
    weight = lambda table: F.coalesce(*(F.when(F.col("branch") == k, F.lit(v)) for k, v in table.items()), F.lit(0.0))
    part = scaled * F.when(F.col("with_entity"), weight(WEIGHTS_ENTITY)).otherwise(weight(WEIGHTS))
    return best(found.withColumn("part", part).groupBy("query_id", *CHUNK_KEY).agg(F.round(F.sum("part"), 6).alias("score")), top)


def ranked_scores(fused: DataFrame) -> DataFrame:
    """Scores 1.0, 0.9, ... by rank."""
    return fused.withColumn("score", F.round(1.0 - (F.col("rank") - 1) * 0.1, 1))


def vector_fallback(table: DataFrame, queries: DataFrame, fused: DataFrame, conf: Settings, embedder: Embedder) -> DataFrame:
    """The nearest chunks, each with score 0.5, of queries for which fusion found nothing."""
    empty = queries.join(fused.select("query_id").distinct(), "query_id", "left_anti")
    vectors = empty.select("query_id", embedder.column(tx.terms(F.col("query"))).alias("vector")).filter("vector is not null")
    return knn(table, vectors, conf.branch_top).withColumn("score", F.lit(0.5))


def hybrid(table: DataFrame | Index, queries: DataFrame, document_ids: list | None = None, content_type: str | None = None, name: str | None = None, conf: Settings = Settings(), embedder: Embedder | None = None) -> DataFrame:
    """(query_id, key, score, rank): the strategy follows the number of documents asked for and the type of a single one."""
    embedder = embedder or HashEmbedder(conf.embedding_dim)
    if document_ids and not isinstance(table, Index):
        table = table.filter(F.col("document_id").isin(document_ids))  # before ranking, so that k rows come back
    multi = len(document_ids or []) != 1
    sheet = not multi and any(x in (content_type or "") for x in ("spreadsheet", "ms-excel")) or (not multi and (name or "").lower().endswith((".xlsx", ".xls")))
    found = branches(table, queries, conf, embedder, multi, sheet, document_ids)
    fused = weighted_sum(found, conf.branch_top) if multi else rrf(found, conf.rrf_constant, conf.branch_top)
    done = ranked_scores(fused)
    return done.unionByName(vector_fallback(table.chunks(document_ids) if isinstance(table, Index) else table, queries, done, conf, embedder).select(*done.columns))


def sources(hits: DataFrame, documents: DataFrame) -> DataFrame:
    """hits(query_id, document_id, score, rank) -> one source for each document, with the score of its first hit."""
    first = hits.groupBy("query_id", "document_id").agg(F.min_by("score", "rank").alias("confidence_score"), F.min("rank").alias("rank"))
    named = first.join(documents.select("document_id", "document_name"), "document_id", "left")
    return named.select("query_id", "rank", "document_id", F.coalesce("document_name", F.lit(UNKNOWN)).alias("document_name"), F.lit("").alias("content"), "confidence_score")
