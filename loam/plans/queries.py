"""Queries for the engine's own operators over whole tables, and the SQL that DuckDB checks them by."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Settings
from ..functions import text as tx
from ..models import HashEmbedder
from ..operators import catalog, chat, graph, search
from ..operators.index import Index
from ..operators.ingest import chunk_documents
from ..sources.files import html_text

CONF = Settings()
#: Questions asked of the test tables, as a parameter of the search queries.
QUESTIONS = ((1, "the tion of ing"), (2, "der schen und heit"), (3, "les mentre Qui, eau que"), (4, "src1 and that entint"), (5, "zzzz"), (6, "heat of Zqxwvk tion"))


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents")


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select(F.col("doc_id").alias("document_id"), F.col("source").alias("document_name"), F.lit("").alias("sheet_name"), "text")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_documents(parts(spark, sf_dir), CONF, one_part=True)


_built: dict[tuple, Index | DataFrame] = {}


def folder(spark: SparkSession, tag: str) -> str:
    """A new folder that executors share; a temporary one only where spark.checkpoint.dir is not set."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    return f"{base.rstrip('/')}/loam-{tag}-{uuid.uuid4().hex}" if base else tempfile.mkdtemp(prefix=f"loam-{tag}-")


def index(spark: SparkSession, sf_dir: str) -> Index:
    """The stored index of the documents, built at its first use in an application."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _built:
        _built[key] = Index(spark, folder(spark, "index")).build(parts(spark, sf_dir), CONF, HashEmbedder(CONF.embedding_dim), one_part=True)
    return _built[key]


def questions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(QUESTIONS, "query_id int, query string")


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as catalogue rows; times follow the ids, as the table has none."""
    return docs(spark, sf_dir).select(F.col("doc_id").alias("id"), F.col("source").alias("file_name"), F.concat(F.lit("text/"), "lang").alias("content_type"), F.lit("PENDING").alias("status"), F.col("n_chars").alias("content_length"), F.timestamp_seconds(F.col("doc_id") % 97).alias("created_at"))


# scans, catalogue and mutations
def catalog_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.listed(catalogue(spark, sf_dir)).select("id", "file_name", "content_type", "status", "content_length", F.unix_timestamp("created_at").alias("created_s"))


def catalog_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = catalog.metrics(parts(spark, sf_dir), chunks(spark, sf_dir))
    labels = load(spark, sf_dir, "labels").select(F.col("doc_id").alias("document_id"), "quality")
    done = docs(spark, sf_dir).select(F.col("doc_id").alias("document_id"), "source").join(m, "document_id", "left").join(labels, "document_id", "left")
    return done.groupBy("source").agg(F.count(F.lit(1)).alias("n_documents"), F.sum("content_length").alias("n_chars"), F.sum("chunk_count").alias("n_chunks"), F.count("quality").alias("n_rated"))


def status_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pending documents are completed with their metrics; those without text failed."""
    m = catalog.metrics(parts(spark, sf_dir), chunks(spark, sf_dir))
    changes = m.select(F.col("document_id").alias("id"), F.when(F.col("content_length") > 0, "COMPLETED").otherwise("FAILED").alias("status"), "content_length")
    return catalog.updated(catalogue(spark, sf_dir), changes).select("id", "file_name", "status", "content_length")


def status_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last state of each document in an append-only log: a third of them are pending, a third in work, the others done or,
    every fifth, failed; the last two entries of a document have the same time."""
    base = docs(spark, sf_dir).select(F.col("doc_id").cast("string").alias("id"), F.col("doc_id").alias("n"))
    states = (F.lit("PENDING"), F.lit("PROCESSING"), F.when(F.col("n") % 5 == 0, "FAILED").otherwise("COMPLETED"))
    entries = F.array(*(F.struct(s.alias("status"), F.timestamp_seconds(F.lit(min(i, 1))).alias("updated_at")) for i, s in enumerate(states)))
    log = base.select("id", F.explode(F.slice(entries, F.lit(1), (F.col("n") % 3 + 1).cast("int"))).alias("e")).select("id", "e.*")
    return catalog.current(log).select("id", "status")


def delete_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks left for each document name when all documents named src3 are deleted."""
    gone = catalogue(spark, sf_dir).filter("file_name = 'src3'").select("id")
    left = catalog.without(chunks(spark, sf_dir), gone, "document_id")
    return left.groupBy("document_name").agg(F.countDistinct("document_id").alias("n_documents"), F.count(F.lit(1)).alias("n_chunks"))


# text functions
def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", F.posexplode(tx.sentences(F.col("text"))).alias("pos", "sentence")).withColumn("pos", F.col("pos").cast("long"))


def sentence_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", F.filter(tx.sentences(F.col("text")), lambda s: tx.eligible_sentence(s)).alias("s")).select("doc_id", F.size("s").cast("long").alias("n_eligible"))


def chunk_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks(spark, sf_dir).select("document_id", F.col("chunk_idx").cast("long").alias("chunk_idx"), "document_name", "sheet_name", "chunk_text")


def token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", tx.token_estimate(F.col("text")).alias("n_tokens"))


def token_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", tx.token_limit(F.col("text"), CONF.token_limit).alias("t")).select("doc_id", "t.*")


def token_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", F.posexplode(tx.split_by_tokens(F.col("text"), CONF.chunk_tokens)).alias("pos", "piece")).withColumn("pos", F.col("pos").cast("long"))


def token_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks split again under a guard of 60 tokens."""
    done = chunk_documents(parts(spark, sf_dir), Settings(chunk_tokens=60), one_part=True, guard=True)
    return done.groupBy("document_id").agg(F.count(F.lit(1)).alias("n_pieces"), F.max(F.length("chunk_text")).cast("long").alias("longest"), F.sum(F.length(F.regexp_replace("chunk_text", r"\s+", ""))).alias("n_solid"))


def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", tx.normalised(F.col("text")).alias("normalized"))


def reply_cleaning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation texts in code fences come out as they were."""
    fenced = F.concat(F.lit("​```python\n"), tx.stripped(F.col("text")), F.lit("\n```"))
    return load(spark, sf_dir, "conversations").filter("text is not null").select("conv_id", "turn", tx.cleaned_reply(fenced).alias("cleaned"))


def rerank_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies made of turn numbers, read as places among five hits."""
    reply = F.concat(F.col("turn").cast("string"), F.lit(", x, "), (F.col("turn") % 7).cast("string"), F.lit(", 2"))
    return load(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(tx.reranked(reply, F.lit(5)).cast("array<string>"), ",").alias("places"))


def answer_success(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("turn") % 3 == 0, F.concat(F.col("text"), F.lit(" Не удалось найти"))).otherwise(F.col("text"))
    return load(spark, sf_dir, "conversations").filter("role = 'assistant'").select("conv_id", "turn", tx.answered(text).alias("answered"))


# full-text index and retrieval
def term_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index(spark, sf_dir).read("terms")


def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = search.query_terms(questions(spark), tx.terms(F.col("query")))
    return keyed(content_hits(spark, sf_dir, q))


def content_hits(spark: SparkSession, sf_dir: str, asked: DataFrame) -> DataFrame:
    found, stats = index(spark, sf_dir).field("content", [r["term"] for r in asked.select("term").distinct().collect()])
    return search.bm25(found, asked, CONF.branch_top, CONF, stats=stats)


def keyed(hits: DataFrame) -> DataFrame:
    return hits.select("query_id", "document_id", F.col("chunk_idx").cast("long").alias("chunk_idx"), "score", F.col("rank").cast("long").alias("rank"))


def hash_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of filled buckets and the squared length of each document's vector."""
    v = HashEmbedder(CONF.embedding_dim).column(tx.terms(F.col("text")))
    done = docs(spark, sf_dir).select("doc_id", v.alias("v"))
    return done.select("doc_id", F.coalesce(F.size(F.filter("v", lambda x: x > 0)), F.lit(0)).cast("long").alias("n_filled"), F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x), 6).alias("squared"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "embeddings").select("vec_id", "label", tx.widened(F.col("embedding")).alias("embedding"))


def centroids(v: DataFrame) -> DataFrame:
    """The mean vector of each label, at most a few dozen; they serve as queries."""
    means = v.select("label", F.posexplode("embedding")).groupBy("label", "pos").agg(F.avg("col").alias("x"))
    return means.groupBy(F.col("label").alias("query_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("vector"))


def knn_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir)
    return search.knn(v, centroids(v), 10, key=("vec_id",)).withColumn("rank", F.col("rank").cast("long"))


def knn_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filtered before ranking: only vectors of other labels than 3 and 7."""
    v = vectors(spark, sf_dir)
    return search.knn(v.filter("label not in (3, 7)"), centroids(v), 10, key=("vec_id",)).withColumn("rank", F.col("rank").cast("long"))


def hybrid_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search.branches(index(spark, sf_dir), questions(spark), CONF, HashEmbedder(CONF.embedding_dim), False, False)
    return keyed(search.rrf(found, CONF.rrf_constant))


def hybrid_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search.branches(index(spark, sf_dir), questions(spark), CONF, HashEmbedder(CONF.embedding_dim), True, True)
    return keyed(search.ranked_scores(search.weighted_sum(found)))


def vector_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full-text search alone is fused; the questions it leaves empty fall back to vectors."""
    q = questions(spark)
    fused = content_hits(spark, sf_dir, search.query_terms(q, tx.terms(F.col("query"))))
    return keyed(search.vector_fallback(index(spark, sf_dir).chunks(), q, fused, CONF, HashEmbedder(CONF.embedding_dim)))


def sources_per_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources of the full-text hits; the names of src2 are taken to be lost."""
    known = docs(spark, sf_dir).filter("source <> 'src2'").select(F.col("doc_id").alias("document_id"), F.col("source").alias("document_name"))
    return search.sources(bm25_topk(spark, sf_dir), known).withColumnRenamed("rank", "first_rank")


# graph
def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities and relations of the first chunks, stored at their first use in an application: each table of the graph reads
    these and not the texts."""
    key = (spark.sparkContext.applicationId, sf_dir, "graph")
    if key not in _built:
        rows, path = graph.found_rows(chunks(spark, sf_dir), CONF.graph_chunks), folder(spark, "graph")
        rows.write.mode("overwrite").parquet(path)
        _built[key] = spark.read.schema(rows.schema).parquet(path)
    return _built[key]


def the_graph(spark: SparkSession, sf_dir: str) -> graph.Graph:
    return graph.build_graph(chunks(spark, sf_dir), CONF.graph_chunks, found=found(spark, sf_dir))


def entity_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return the_graph(spark, sf_dir).entities


def mention_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return the_graph(spark, sf_dir).mentions


def relation_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return the_graph(spark, sf_dir).relations


def cooccurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.cooccurrence(the_graph(spark, sf_dir), top_entities(spark, sf_dir)).withColumn("rank", F.col("rank").cast("long"))


def top_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three entity names that most documents hold: the questions asked of the graph."""
    m = graph.mentions_of(found(spark, sf_dir))
    return m.groupBy(F.col("name").alias("query_entity")).agg(F.countDistinct("document_id").alias("n")).orderBy(F.desc("n"), "query_entity").limit(3).select("query_entity")


def related_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.related(the_graph(spark, sf_dir), top_entities(spark, sf_dir)).withColumn("rank", F.col("rank").cast("long"))


# conversation, files, streaming
def history_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.history(load(spark, sf_dir, "conversations"))


def last_question(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.last_question(load(spark, sf_dir, "conversations"))


def numbered_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = chunks(spark, sf_dir).groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("chunk_idx", "chunk_text"))).alias("c"))
    return listed.select("document_id", tx.numbered(F.transform("c", lambda x: x["chunk_text"])).alias("context"))


def html_to_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = F.pandas_udf(lambda s: s.fillna("").map(html_text), "string")
    return load(spark, sf_dir, "pages").select("page_id", "url", read("html").alias("text"))


def ingest_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks of chunk_pack, made by a stream over the same file."""
    from ..streaming.ingest import ingest_stream as stream

    base = spark.conf.get("spark.checkpoint.dir", None)
    home = f"{base.rstrip('/')}/loam-stream-{uuid.uuid4().hex}" if base else tempfile.mkdtemp(prefix="loam-stream-")
    if not base:
        shutil.rmtree(home)
    schema = docs(spark, sf_dir).schema.simpleString()[len("struct<") : -1].replace(":", " ")
    done = stream(spark, sf_dir, schema, "documents.parquet", f"{home}/out", f"{home}/log", CONF)
    return done.select("document_id", F.col("chunk_idx").cast("long").alias("chunk_idx"), "document_name", "sheet_name", "chunk_text")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (catalog_list, catalog_rollup, status_update, status_current, delete_cascade, sentence_split, sentence_filter, chunk_pack, token_estimate, token_limit, token_split, token_guard, normalize_text, reply_cleaning, rerank_parse, answer_success, term_statistics, bm25_topk, hash_embedding, knn_cosine, knn_filtered, hybrid_rrf, hybrid_weighted, vector_fallback, sources_per_document, entity_nodes, mention_edges, relation_edges, cooccurrence, related_entities, history_fold, last_question, numbered_context, html_to_text, ingest_stream)
}

STOP = ", ".join(f"'{w}'" for w in tx.STOP_WORDS)
ASKED = ", ".join(f"({i}, '{q}')" for i, q in QUESTIONS)
#: Stages shared by the statements below.
WITH = {
    "sents": r"""sents AS (SELECT doc_id, source, list_filter(string_split(regexp_replace(coalesce(text, ''), '([.!?]+)\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g') <> '') AS s FROM documents)""",
    "packed": r"""packed AS (SELECT doc_id, source, list_reduce(s, lambda a, x: CASE WHEN length(a.o) + length(x) > 500
          THEN {'d': list_append(a.d, regexp_replace(a.o, '^\s+|\s+$', '', 'g')), 'o': right(a.o, 100) || x || ' '} ELSE {'d': a.d, 'o': a.o || x || ' '} END,
          {'d': CAST([] AS VARCHAR[]), 'o': ''}) AS p FROM sents)""",
    "listed": r"""listed AS (SELECT doc_id, source, list_filter(list_append(p.d, regexp_replace(p.o, '^\s+|\s+$', '', 'g')), lambda c: c <> '') AS c FROM packed)""",
    "chunk": """chunk AS (SELECT doc_id AS document_id, CAST(i - 1 AS BIGINT) AS chunk_idx, coalesce(source, 'Unknown Document') AS document_name, '' AS sheet_name, c[i] AS chunk_text FROM listed, LATERAL (SELECT unnest(range(1, len(c) + 1)) AS i))""",
    "words": rf"""words AS (SELECT *, list_filter(regexp_split_to_array(lower(chunk_text), '\s+'), lambda w: regexp_full_match(w, '[\p{{L}}\p{{N}}]+') AND NOT list_contains([{STOP}], w)) AS w FROM chunk)""",
    "asked": rf"""asked AS (SELECT * FROM (VALUES {ASKED}) t(query_id, query)),
      qwords AS (SELECT query_id, query, list_filter(regexp_split_to_array(lower(query), '\s+'), lambda w: regexp_full_match(w, '[\p{{L}}\p{{N}}]+') AND NOT list_contains([{STOP}], w)) AS w FROM asked)""",
}
CHUNKS = ", ".join(WITH[k] for k in ("sents", "packed", "listed", "chunk"))
TABLE = f"{CHUNKS}, {WITH['words']}, {WITH['asked']}"


def bm25_sql(name: str, words: str, terms: str, top: int) -> str:
    """CTEs ending in `name`: words selects (document_id, chunk_idx, w list), terms selects (query_id, term)."""
    return f"""{name}_w AS ({words}), {name}_q AS ({terms}),
      {name}_p AS (SELECT document_id, chunk_idx, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT document_id, chunk_idx, len(w) AS dl, unnest(w) AS term FROM {name}_w) GROUP BY ALL),
      {name}_s AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM (SELECT DISTINCT document_id, chunk_idx, dl FROM {name}_p)),
      {name}_d AS (SELECT term, count(*) AS df FROM {name}_p GROUP BY term),
      {name}_b AS (SELECT query_id, document_id, chunk_idx, round(sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 6) AS score
                   FROM {name}_p JOIN {name}_d USING (term) JOIN {name}_q USING (term), {name}_s GROUP BY ALL),
      {name} AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, document_id, chunk_idx) AS rank FROM {name}_b QUALIFY rank <= {top})"""


def vector_sql(name: str, rows: str, key: str) -> str:
    """(key, bucket, x) of unit vectors over MD5 buckets."""
    return f"""{name} AS (SELECT {key}, bucket, n / sqrt(sum(n * n) OVER (PARTITION BY {key})) AS x FROM
      (SELECT {key}, ('0x' || substr(md5(t), 1, 8))::BIGINT % {CONF.embedding_dim} AS bucket, count(*)::DOUBLE AS n FROM (SELECT {key}, unnest(w) AS t FROM {rows}) GROUP BY ALL))"""


CONTENT = bm25_sql("content", "SELECT document_id, chunk_idx, w FROM words", "SELECT DISTINCT query_id, unnest(w) AS term FROM qwords", 10)
KNN = (
    vector_sql("cvec", "words", "document_id, chunk_idx") + ", " + vector_sql("qvec", "qwords", "query_id") + """,
      knn AS (SELECT query_id, document_id, chunk_idx, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, document_id, chunk_idx) AS rank FROM (
        SELECT query_id, document_id, chunk_idx, round(coalesce(sum(c.x * q.x), 0), 6) AS score
        FROM (SELECT DISTINCT document_id, chunk_idx FROM cvec) k CROSS JOIN (SELECT DISTINCT query_id FROM qvec) a
        LEFT JOIN cvec c USING (document_id, chunk_idx) LEFT JOIN qvec q USING (query_id, bucket) GROUP BY ALL) QUALIFY rank <= 10)"""
)
NAME_WORDS = r"list_filter(regexp_split_to_array(lower({}), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '')"
NAMES = bm25_sql("names", f"SELECT document_id, chunk_idx, {NAME_WORDS.format('document_name')} AS w FROM chunk", f"SELECT DISTINCT query_id, unnest({NAME_WORDS.format('query')}) AS term FROM asked", 5)
FOUND = r"regexp_extract_all({0}, '[\p{{Ll}},;] (\p{{Lu}}\p{{Ll}}{{2,}})', 1)"
ENTITY = f"list_filter({FOUND}, lambda w, i: list_position({FOUND}, w) = i)"
ENTITIES = bm25_sql("entity", "SELECT document_id, chunk_idx, w FROM words", rf"SELECT DISTINCT query_id, lower(unnest({ENTITY.format('query')})) AS term FROM asked", 5)
BRANCH = "SELECT query_id, '{0}' AS branch, document_id, chunk_idx, score, rank FROM {0}"
MENTIONS = rf"""mention AS (SELECT document_id, chunk_idx, unnest({ENTITY.format('chunk_text')}) AS name FROM chunk WHERE chunk_idx < 10)"""
RELATIONS = rf"""sent AS (SELECT document_id, unnest(list_filter(string_split(regexp_replace(chunk_text, '([.!?]+)\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g') <> '')) AS s FROM chunk WHERE chunk_idx < 10),
      ent AS (SELECT document_id, s, {ENTITY.format('s')} AS e FROM sent WHERE length(s) BETWEEN 10 AND 500 AND regexp_matches(s, '\p{{L}}') AND length(regexp_replace(s, '[^\p{{Lu}}]', '', 'g')) * 2 <= length(s)),
      rel AS (SELECT DISTINCT document_id, e[i] AS subj, regexp_extract(s, regexp_escape(e[i]) || '\s+(.{{1,60}}?)\s+' || regexp_escape(e[i + 1]), 1) AS rel, e[i + 1] AS obj FROM ent, LATERAL (SELECT unnest(range(1, len(e))) AS i) WHERE len(e) > 1),
      relation AS (SELECT * FROM rel WHERE trim(rel) <> '')"""
NODES = """node AS (SELECT document_id || '_' || name AS id, name, CAST(document_id AS VARCHAR) AS document_id, min_by(type, o) AS type FROM (
        SELECT document_id, name, 'ENTITY' AS type, 0 AS o FROM mention UNION ALL SELECT document_id, unnest([subj, obj]), 'EXTRACTED', 1 FROM relation) GROUP BY 1, 2, 3)"""
TOP3 = "top3 AS (SELECT name AS query_entity FROM mention GROUP BY name ORDER BY count(DISTINCT document_id) DESC, name LIMIT 3)"
CENTROID = """v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
      m AS (SELECT label, i, avg(e[i]) AS x FROM v, LATERAL (SELECT unnest(range(1, len(e) + 1)) AS i) GROUP BY ALL),
      c AS (SELECT label AS query_id, list(x ORDER BY i) AS q FROM m GROUP BY label)"""


def nearest(where: str) -> str:
    return f"""WITH {CENTROID}, s AS (SELECT query_id, vec_id, round(list_cosine_similarity(e, q), 6) AS score FROM v, c WHERE {where})
      SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s QUALIFY rank <= 10"""


CATALOGUE = "SELECT doc_id AS id, source AS file_name, 'text/' || lang AS content_type, 'PENDING' AS status, n_chars AS content_length, CAST(doc_id % 97 AS BIGINT) AS created_s FROM documents"

ORACLE: dict[str, str] = {
    "catalog_list": CATALOGUE,
    "catalog_rollup": f"""WITH {CHUNKS}, k AS (SELECT document_id AS doc_id, count(*) AS n FROM chunk GROUP BY 1)
      SELECT source, count(*) AS n_documents, CAST(sum(length(coalesce(text, ''))) AS BIGINT) AS n_chars, CAST(sum(coalesce(n, 0)) AS BIGINT) AS n_chunks, count(quality) AS n_rated
      FROM documents LEFT JOIN k USING (doc_id) LEFT JOIN labels USING (doc_id) GROUP BY source""",
    "status_update": "SELECT doc_id AS id, source AS file_name, CASE WHEN length(coalesce(text, '')) > 0 THEN 'COMPLETED' ELSE 'FAILED' END AS status, length(coalesce(text, '')) AS content_length FROM documents",
    "status_current": "SELECT CAST(doc_id AS VARCHAR) AS id, CASE doc_id % 3 WHEN 0 THEN 'PENDING' WHEN 1 THEN 'PROCESSING' ELSE CASE WHEN doc_id % 5 = 0 THEN 'FAILED' ELSE 'COMPLETED' END END AS status FROM documents",
    "delete_cascade": f"WITH {CHUNKS} SELECT document_name, count(DISTINCT document_id) AS n_documents, count(*) AS n_chunks FROM chunk WHERE document_id NOT IN (SELECT doc_id FROM documents WHERE source = 'src3') GROUP BY 1",
    "sentence_split": f"WITH {WITH['sents']} SELECT doc_id, CAST(i - 1 AS BIGINT) AS pos, s[i] AS sentence FROM sents, LATERAL (SELECT unnest(range(1, len(s) + 1)) AS i)",
    "sentence_filter": rf"WITH {WITH['sents']} SELECT doc_id, len(list_filter(s, lambda x: length(x) BETWEEN 10 AND 500 AND regexp_matches(x, '\p{{L}}') AND length(regexp_replace(x, '[^\p{{Lu}}]', '', 'g')) * 2 <= length(x))) AS n_eligible FROM sents",
    "chunk_pack": f"WITH {CHUNKS} SELECT * FROM chunk",
    "ingest_stream": f"WITH {CHUNKS} SELECT * FROM chunk",
    "numbered_context": f"WITH {CHUNKS} SELECT document_id, string_agg('[' || (chunk_idx + 1) || '] ' || chunk_text, chr(10) ORDER BY chunk_idx) AS context FROM chunk GROUP BY 1",
    "token_estimate": """WITH n AS (SELECT doc_id, coalesce(text, '') AS t, length(regexp_replace(coalesce(text, ''), '[^а-яА-Я]', '', 'g')) AS c, length(regexp_replace(coalesce(text, ''), '[^a-zA-Z]', '', 'g')) AS l, length(regexp_replace(coalesce(text, ''), '[^ ]', '', 'g')) AS b FROM documents)
      SELECT doc_id, CASE WHEN t = '' THEN 0 ELSE greatest(1, CAST(floor((c * 0.5::DOUBLE + l * 0.4::DOUBLE + (length(t) - c - l - b) * 0.3::DOUBLE + b * 0.1::DOUBLE) * 1.2::DOUBLE) AS BIGINT)) END AS n_tokens FROM n""",
    "normalize_text": rf"SELECT doc_id, array_to_string(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '\s+'), lambda w: regexp_full_match(w, '[\p{{L}}\p{{N}}]+') AND NOT list_contains([{STOP}], w)), ' ') AS normalized FROM documents",
    "reply_cleaning": r"SELECT conv_id, turn, regexp_replace(regexp_replace(regexp_replace(text, '[\x{200b}-\x{200d}\x{feff}]', '', 'g'), '^\s+|\s+$', '', 'g'), '^`|`$', '', 'g') AS cleaned FROM conversations WHERE text IS NOT NULL",
    "rerank_parse": """WITH r AS (SELECT conv_id, turn, list_filter([turn - 1, turn % 7 - 1, 1], lambda i: i >= 0 AND i < 5) AS p FROM conversations)
      SELECT conv_id, turn, array_to_string(list_transform(list_filter(range(1, len(p) + 1), lambda i: list_position(p, p[i]) = i), lambda i: p[i]), ',') AS places FROM r""",
    "answer_success": "SELECT conv_id, turn, NOT regexp_matches(lower(CASE WHEN turn % 3 = 0 THEN text || ' Не удалось найти' ELSE text END), '" + "|".join(tx.NOT_FOUND) + "') AS answered FROM conversations WHERE role = 'assistant'",
    "term_statistics": f"WITH {TABLE} SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM (SELECT document_id, chunk_idx, term, count(*) AS tf FROM (SELECT document_id, chunk_idx, unnest(w) AS term FROM words) GROUP BY ALL) GROUP BY term",
    "bm25_topk": f"WITH {TABLE}, {CONTENT} SELECT * FROM content",
    "hash_embedding": rf"""WITH words AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '\s+'), lambda w: regexp_full_match(w, '[\p{{L}}\p{{N}}]+') AND NOT list_contains([{STOP}], w)) AS w FROM documents), {vector_sql('vec', 'words', 'doc_id')}
      SELECT doc_id, coalesce(n_filled, 0) AS n_filled, round(squared, 6) AS squared FROM words LEFT JOIN (SELECT doc_id, count(*) AS n_filled, sum(x * x) AS squared FROM vec GROUP BY 1) USING (doc_id)""",
    "knn_cosine": nearest("true"),
    "knn_filtered": nearest("label NOT IN (3, 7)"),
    "hybrid_rrf": f"""WITH {TABLE}, {CONTENT}, {KNN}, {ENTITIES}, f AS ({BRANCH.format('knn')} UNION ALL {BRANCH.format('content')} UNION ALL {BRANCH.format('entity')}),
      g AS (SELECT query_id, document_id, chunk_idx, round(sum(1 / (60::DOUBLE + rank)), 9) AS score FROM f GROUP BY ALL)
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, document_id, chunk_idx) AS rank FROM g QUALIFY rank <= 10""",
    "hybrid_weighted": f"""WITH {TABLE}, {CONTENT}, {KNN}, {NAMES}, {ENTITIES}, f AS ({BRANCH.format('knn')} UNION ALL {BRANCH.format('content')} UNION ALL {BRANCH.format('names')} UNION ALL {BRANCH.format('entity')}),
      s AS (SELECT *, min(score) OVER b AS low, max(score) OVER b AS high, (SELECT len({ENTITY.format('query')}) > 0 FROM asked WHERE asked.query_id = f.query_id) AS e FROM f WINDOW b AS (PARTITION BY query_id, branch)),
      g AS (SELECT query_id, document_id, chunk_idx, round(sum(CASE WHEN high > low THEN (score - low) / (high - low) ELSE 1.0::DOUBLE END * CASE branch WHEN 'knn' THEN CASE WHEN e THEN 0.35::DOUBLE ELSE 0.4::DOUBLE END
              WHEN 'content' THEN CASE WHEN e THEN 0.25::DOUBLE ELSE 0.3::DOUBLE END WHEN 'names' THEN CASE WHEN e THEN 0.1::DOUBLE ELSE 0.15::DOUBLE END ELSE 0.2::DOUBLE END), 6) AS score FROM s GROUP BY ALL),
      r AS (SELECT query_id, document_id, chunk_idx, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, document_id, chunk_idx) AS rank FROM g QUALIFY rank <= 10)
      SELECT query_id, document_id, chunk_idx, round(1.0::DOUBLE - (rank - 1) * 0.1::DOUBLE, 1) AS score, rank FROM r""",
    "vector_fallback": f"WITH {TABLE}, {CONTENT}, {KNN} SELECT query_id, document_id, chunk_idx, 0.5::DOUBLE AS score, rank FROM knn WHERE query_id NOT IN (SELECT query_id FROM content)",
    "sources_per_document": f"""WITH {TABLE}, {CONTENT}, h AS (SELECT query_id, document_id, min_by(score, rank) AS confidence_score, min(rank) AS first_rank FROM content GROUP BY ALL)
      SELECT query_id, first_rank, document_id, CASE WHEN source <> 'src2' THEN source ELSE 'Неизвестный документ' END AS document_name, '' AS content, confidence_score FROM h LEFT JOIN documents ON doc_id = document_id""",
    "entity_nodes": f"WITH {CHUNKS}, {MENTIONS}, {RELATIONS}, {NODES} SELECT id, name, type, document_id FROM node",
    "mention_edges": f"WITH {CHUNKS}, {MENTIONS} SELECT DISTINCT document_id || '_chunk_' || chunk_idx AS src, document_id || '_' || name AS dst FROM mention",
    "relation_edges": f"WITH {CHUNKS}, {RELATIONS} SELECT DISTINCT document_id || '_' || subj AS src, document_id || '_' || obj AS dst, rel AS type FROM relation",
    "cooccurrence": f"""WITH {CHUNKS}, {MENTIONS}, {TOP3}, d AS (SELECT DISTINCT document_id, name FROM mention),
      f AS (SELECT DISTINCT query_entity, b.name, CAST(b.document_id AS VARCHAR) AS document_id FROM top3 JOIN d a ON a.name = query_entity JOIN d b ON a.document_id = b.document_id AND a.name <> b.name)
      SELECT query_entity, row_number() OVER (PARTITION BY query_entity ORDER BY name, document_id) AS rank, name, document_id, name || ' (из документа ' || left(document_id, 8) || '...)' AS label FROM f QUALIFY rank <= 10""",
    "related_entities": f"""WITH {CHUNKS}, {MENTIONS}, {RELATIONS}, {TOP3}, f AS (SELECT DISTINCT query_entity, obj AS name, CAST(document_id AS VARCHAR) AS document_id FROM top3 JOIN relation ON subj = query_entity)
      SELECT query_entity, row_number() OVER (PARTITION BY query_entity ORDER BY name, document_id) AS rank, name, document_id, name || ' (связана с ' || query_entity || ')' AS label FROM f QUALIFY rank <= 5""",
    "history_fold": "SELECT conv_id, string_agg(role || ': ' || coalesce(text, ''), chr(10) ORDER BY turn) AS history, count(*) AS n_turns FROM conversations WHERE role IN ('user', 'assistant') GROUP BY 1",
    "last_question": "SELECT conv_id, max_by(text, turn) AS question, max(turn) AS turn FROM conversations WHERE role = 'user' GROUP BY 1",
}
ORACLE["token_limit"] = f"WITH e AS ({ORACLE['token_estimate']}), t AS (SELECT doc_id, CASE WHEN trim(coalesce(text, '')) = '' THEN 0 ELSE n_tokens END AS n_tokens FROM e JOIN documents USING (doc_id)) SELECT doc_id, n_tokens <= {CONF.token_limit} AS within, n_tokens FROM t"
