"""Queries over the whole tables, one for each operator, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import encode
from .common import load
from .exact_dedup import exact_dedup
from .line_dedup import line_dedup
from .mixing import mix
from .quality import ordinal_quality
from .simhash import simhash_components
from .suffix_dedup import remove_repeats
from .topk import quantised, top_k, usable
from .toxicity import fold, toxicity
from .url_filter import host, path, url_filter

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup(load(spark, sf_dir, "documents"), min_lines=2)
    return done.select("doc_id", "line_dedup.*", F.sha2(F.col("text"), 256).alias("kept_sha256"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(load(spark, sf_dir, "documents"), repeat_limit=2.0)
    return mixed.select("doc_id", *(F.col(f"mix.{c}").alias(c) for c in ("source", "n_tokens", "epoch", "block", "block_order", "doc_order")))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(load(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted", F.col("ratio").alias("llr_per_word"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = encode(load(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), decoded=True)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = load(spark, sf_dir, "embeddings").select("vec_id", "embedding").filter(usable(F.col("embedding")))
    vectors = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), quantised(F.col("embedding")).alias("v"))
    return top_k(vectors, vectors.filter("vec_id % 100 = 0"), k=10)


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = remove_repeats(load(spark, sf_dir, "documents"), width=100)
    removed = F.aggregate(F.zip_with("spans_hi", "spans_lo", lambda h, l: h - l), F.lit(0).cast("long"), lambda a, x: a + x)
    return done.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans_lo").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def listed_hosts(pages: DataFrame) -> DataFrame:
    """A dated list made from the pages' own hosts, as the tables have none: a host whose MD5 says so is added, removed 60
    days later and added again after 120; of some others one path is added."""
    where = F.concat(host(F.col("url")), F.lit("/"), F.element_at(F.split(F.concat(path(F.col("url")), F.lit("/")), "/"), 2))
    draw = lambda c: F.conv(F.substring(F.md5(c.cast("binary")), 1, 4), 16, 10).cast("int")
    day = lambda n: F.date_add(F.lit("2024-01-01").cast("date"), n)
    hosts = pages.filter("url is not null").select(host(F.col("url")).alias("key")).distinct().withColumn("k", draw(F.col("key"))).filter("k % 4 = 0")
    dated = F.array(*(F.struct(F.lit(a).alias("action"), day(F.col("k") % 300 + n).alias("since")) for a, n in (("add", 0), ("remove", 60), ("add", 120))))
    paths = pages.filter("url is not null").select(where.alias("key")).distinct().withColumn("k", draw(F.col("key"))).filter("k % 5 = 0 and not endswith(key, '/')")
    return hosts.select("key", F.explode(dated).alias("e")).select("key", "e.action", "e.since").unionByName(paths.select("key", F.lit("add").alias("action"), day(F.col("k") % 365).alias("since")))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fetch dates spread over 2024 by page_id, as the pages carry none."""
    pages = load(spark, sf_dir, "pages").select("page_id", "url")
    captures = pages.withColumn("fetched", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") * 37 % 366).cast("int")))
    done = url_filter(captures, listed_hosts(pages))
    return done.select("page_id", F.col("fetched").cast("string").alias("fetched"), "url_filter.*")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grades: 0 low quality, 1 good but toxic, 2 good. Rows whose crc32(doc_id as text) mod 5 is 0 are held out of the fit."""
    graded = load(spark, sf_dir, "labels").filter(fold("doc_id") != 0).select("doc_id", (F.col("quality") * (2 - F.col("toxic"))).alias("grade"))
    return ordinal_quality(load(spark, sf_dir, "documents"), graded, pass_grade=1, sample=6_000)


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(load(spark, sf_dir, "documents"), k=3, radius=2)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_mixing": op2_mixing,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_toxicity": op4_toxicity,
    "op5_bpe": op5_bpe,
    "op6_topk": op6_topk,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_url_filter": op8_url_filter,
    "op9_quality": op9_quality,
    "op10_simhash": op10_simhash,
}

ORACLE: dict[str, str] = {
    "op1_line_dedup": """
        WITH l AS (SELECT doc_id, s.i AS pos, string_split(t, chr(10))[s.i] AS line
                   FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents), LATERAL (SELECT unnest(range(1, len(string_split(t, chr(10))) + 1)) AS i) s),
        w AS (SELECT doc_id, pos, line, lead(line) OVER (PARTITION BY doc_id ORDER BY pos) AS nxt FROM l),
        f AS (SELECT doc_id, pos, line, nxt IS NOT NULL AND row_number() OVER (PARTITION BY line, nxt ORDER BY doc_id, pos) > 1 AS later FROM w),
        c AS (SELECT doc_id, pos, line, later OR coalesce(lag(later) OVER (PARTITION BY doc_id ORDER BY pos), false) AS gone,
                     later AND NOT coalesce(lag(later) OVER (PARTITION BY doc_id ORDER BY pos), false)
                           AND NOT coalesce(lag(later, 2) OVER (PARTITION BY doc_id ORDER BY pos), false) AS starts FROM f)
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed, count(*) FILTER (starts) AS n_runs,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
        FROM c GROUP BY doc_id
    """,
    "op2_mixing": r"""
        WITH d AS (SELECT doc_id, coalesce(source, '') AS source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS n_tokens,
                          ('0x' || substr(md5('mix:' || doc_id), 1, 8))::BIGINT AS draw FROM documents),
        s AS (SELECT source, CAST(sum(n_tokens) AS BIGINT) AS t, sum(n_tokens) / (SELECT sum(n_tokens) FROM d)::DOUBLE AS p FROM d GROUP BY source HAVING sum(n_tokens) > 0),
        e AS (SELECT CASE WHEN max(p) / min(p) <= 2 THEN 0.0::DOUBLE ELSE 1 - ln(2::DOUBLE) / ln(max(p) / min(p)) END AS a FROM s),
        w AS (SELECT source, t, pow(p, a) / (SELECT sum(pow(p, a)) FROM s, e) AS weight FROM s, e),
        b AS (SELECT *, CAST(round(weight * (SELECT max(t / weight) FROM w)) AS BIGINT) AS b, CAST(ceil(t / 1e6::DOUBLE) AS BIGINT) AS blocks FROM w),
        q AS (SELECT *, b // t AS epochs, b - (b // t) * t AS rest FROM b
              UNION ALL SELECT source, 0, 0, 0, 1, 0, 0 FROM d GROUP BY source HAVING sum(n_tokens) = 0),
        r AS (SELECT d.*, d.draw % q.blocks AS block, q.epochs, q.rest FROM d JOIN q USING (source)),
        k AS (SELECT source, block, any_value(rest) AS rest, sum(n_tokens) AS size, any_value(md5('mix:' || epochs || ':' || source || ':' || block)) AS ord FROM r GROUP BY source, block),
        l AS (SELECT source, block, size, rest - (sum(size) OVER (PARTITION BY source ORDER BY ord, block ROWS UNBOUNDED PRECEDING) - size) AS remains FROM k),
        x AS (SELECT r.*, l.size, l.remains, sum(n_tokens) OVER (PARTITION BY r.source, r.block ORDER BY md5('mix:' || epochs || ':' || doc_id), CAST(doc_id AS VARCHAR) ROWS UNBOUNDED PRECEDING) AS upto
              FROM r JOIN l USING (source, block)),
        c AS (SELECT *, epochs + CASE WHEN remains >= size THEN 1 WHEN remains > 0 AND upto <= remains THEN 1 ELSE 0 END AS copies FROM x)
        SELECT doc_id, source, n_tokens, CAST(g.e AS INTEGER) AS epoch, block, md5('mix:' || g.e || ':' || source || ':' || block) AS block_order, md5('mix:' || g.e || ':' || doc_id) AS doc_order
        FROM c, LATERAL (SELECT unnest(range(0, copies)) AS e) g
    """,
    "op8_url_filter": r"""
        WITH p AS (SELECT page_id, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)', 1)) AS host,
                          list_filter(string_split(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> '') AS parts,
                          string_split(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) || '/', '/')[2] AS head,
                          CAST(DATE '2024-01-01' + CAST(page_id * 37 % 366 AS INTEGER) AS DATE) AS fetched, url FROM pages),
        h AS (SELECT host AS key, ('0x' || substr(md5(host), 1, 4))::INTEGER AS k FROM (SELECT DISTINCT host FROM p WHERE url IS NOT NULL)),
        g AS (SELECT key, ('0x' || substr(md5(key), 1, 4))::INTEGER AS k FROM (SELECT DISTINCT host || '/' || head AS key FROM p WHERE url IS NOT NULL)),
        spans AS (SELECT key, DATE '2024-01-01' + k % 300 AS since, DATE '2024-01-01' + k % 300 + 60 AS until FROM h WHERE k % 4 = 0
                  UNION ALL SELECT key, DATE '2024-01-01' + k % 300 + 120, DATE '9999-12-31' FROM h WHERE k % 4 = 0
                  UNION ALL SELECT key, DATE '2024-01-01' + k % 365, DATE '9999-12-31' FROM g WHERE k % 5 = 0 AND NOT suffix(key, '/')),
        cand AS (SELECT DISTINCT page_id, fetched, key FROM (
                   SELECT page_id, fetched, array_to_string(string_split(host, '.')[i:], '.') AS key FROM p, LATERAL (SELECT unnest(range(1, greatest(len(string_split(host, '.')) - 1, 1) + 1)) AS i)
                   UNION ALL SELECT page_id, fetched, host || '/' || array_to_string(parts[1:i], '/') FROM p, LATERAL (SELECT unnest(range(1, len(parts) + 1)) AS i))),
        hit AS (SELECT page_id, count(DISTINCT key) AS n, min(key) AS first_key FROM cand JOIN spans USING (key) WHERE since <= fetched AND fetched < until GROUP BY page_id)
        SELECT page_id, CAST(fetched AS VARCHAR) AS fetched, host, coalesce(n, 0) AS n_hits, n IS NOT NULL AS blocked, first_key FROM p LEFT JOIN hit USING (page_id)
    """,
    "op3_exact_dedup": """
        WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents)
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, text_sha256
        FROM d WINDOW g AS (PARTITION BY text_sha256)
    """,
    "op6_topk": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS q FROM embeddings
                   WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT a.vec_id AS query_id, b.vec_id AS vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
              FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id)
        SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
        FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 10
    """,
}
