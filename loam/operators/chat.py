"""Conversation: history, prompts, and the facade that answers a request."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Settings
from ..functions import text as tx
from ..models import Extractive, TextGenerator, overlap_reply
from . import graph as kg
from . import search
from .index import Index


#: Fixed value: stands in the prompt for texts where there are none.
NO_DATA = "Нет данных из документов."


@dataclass
class Reply:
    answer: str
    sources: list[dict] = field(default_factory=list)
    history: list[dict] = field(default_factory=list)
    failed: bool = False


def history(turns: DataFrame, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """One row for each conversation: its user and assistant turns as "role: text" lines, in order."""
    kept = turns.filter(F.col("role").isin("user", "assistant"))
    line = F.concat("role", F.lit(": "), F.coalesce("text", F.lit("")))
    folded = F.array_sort(F.collect_list(F.struct(order, line.alias("line"))))
    return kept.groupBy(key).agg(F.array_join(F.transform(folded, lambda x: x["line"]), "\n").alias("history"), F.count(F.lit(1)).alias("n_turns"))


def last_question(turns: DataFrame, key: str = "conv_id", order: str = "turn") -> DataFrame:
    return turns.filter("role = 'user'").groupBy(key).agg(F.max_by("text", order).alias("question"), F.max(order).alias("turn"))


def condense_prompt(past: str, query: str) -> str:
    return f"Ниже история беседы. Сформулируй последний вопрос так, чтобы он был понятен без неё.\n{past}\nВопрос: {query}\nСамостоятельный вопрос:"


def rewrite_prompt(query: str) -> str:
    return f"Перепиши запрос короче и точнее для поиска по документам. Верни один запрос.\nЗапрос: {query}"


def rerank_prompt(query: str, texts: list[str]) -> str:
    listed = "\n".join(f"[{i}] {t}" for i, t in enumerate(texts, 1))
    return f"Перечисли через запятую номера отрывков, полезных для ответа, от лучшего к худшему.\nВопрос: {query}\n{listed}"


def relations_prompt(sentence: str) -> str:
    return f"Выпиши отношения из предложения как список Python троек (субъект, отношение, объект).\n{sentence}"


def answer_prompt(query: str, texts: list[str], past: str, known: list[str]) -> str:
    context = "\n---\n".join(f"[{i}] {t}" for i, t in enumerate(texts, 1)) if texts else NO_DATA
    return f"Ответь на вопрос по приведённым данным.\nИстория:\n{past}\nДокументы:\n{context}\nСвязи:\n{'; '.join(known)}\nВопрос: {query}"


def chat(spark: SparkSession, table: DataFrame | Index | None, documents: DataFrame, query: str, past: list[dict] | None = None, document_ids: list | None = None, graph: kg.Graph | None = None, generate: TextGenerator | None = None, conf: Settings = Settings()) -> Reply:
    """Condense, rewrite, retrieve, rerank, look up relations, answer. At most ten hits reach the driver.

    The default generator is extractive; then queries are used as they are.
    """
    past = past or []
    lines = "\n".join(f"{m['role']}: {m['content']}" for m in past)
    model = generate or Extractive()

    def attempt(prompt: str, instead: str) -> str:
        if generate is None:
            return instead
        try:
            return generate(prompt).strip() or instead
        except Exception:
            return instead

    condensed = attempt(condense_prompt(lines, query), query) if past else query
    rewritten = attempt(rewrite_prompt(condensed), condensed) if conf.rewrite_queries else condensed
    hits: list = []
    if table is not None:
        asked = spark.createDataFrame([(0, rewritten)], "query_id int, query string")
        one = documents.filter(F.col("document_id") == document_ids[0]).orderBy("document_name").first() if document_ids and len(document_ids) == 1 else None
        kind = one.asDict().get("content_type") if one else None
        found = search.hybrid(table, asked, document_ids, kind, one["document_name"] if one else None, conf)
        stored = table.chunks() if isinstance(table, Index) else table
        hits = found.join(stored.select("document_id", "chunk_idx", "chunk_text"), ["document_id", "chunk_idx"]).orderBy("rank").limit(conf.branch_top).collect()
    texts = [h["chunk_text"] for h in hits]
    if hits:
        order = attempt(rerank_prompt(query, texts), overlap_reply(query, texts))
        places = spark.range(1).select(tx.reranked(F.lit(order), F.lit(len(hits))).alias("p")).first()["p"]
        hits = [hits[i] for i in places]
        texts = [h["chunk_text"] for h in hits]
    known: list[str] = []
    if graph is not None:
        names = spark.range(1).select(F.explode(tx.entities(F.lit(condensed))).alias("query_entity"))
        known = sorted(r["label"] for r in kg.related_labels(graph, names).collect())  # at most 15 for each entity of the query
    new = [*past, {"role": "user", "content": query}]
    if not texts and not known:
        answer = f"По этому вопросу ничего не нашлось: {tx.NOT_FOUND[2]}."
        return Reply(answer, [], [*new, {"role": "assistant", "content": answer}])
    try:
        answer, failed = model(answer_prompt(query, texts, lines, known)), False
    except Exception as e:
        answer, failed = f"Не удалось получить ответ: {type(e).__name__}", True
    sources: list[dict] = []
    if not failed and hits and not any(p in answer.lower() for p in tx.NOT_FOUND):
        ranked = spark.createDataFrame([(0, h["document_id"], float(h["score"]), i) for i, h in enumerate(hits, 1)], search_schema(documents))
        sources = [r.asDict() for r in search.sources(ranked, documents).orderBy("rank").collect()]
    return Reply(answer, sources, [*new, {"role": "assistant", "content": answer}], failed)


def search_schema(documents: DataFrame) -> str:
    return f"query_id int, document_id {documents.schema['document_id'].dataType.simpleString()}, score double, rank int"
