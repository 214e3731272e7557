"""Documents to chunks, embeddings and the full-text index."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import Settings
from ..functions import text as tx
from ..models import Embedder, HashEmbedder

CHUNK_KEY = ("document_id", "chunk_idx")


#: Fixed value: the name of a document without one.
UNNAMED = "Unknown Document"


def chunk_documents(parts: DataFrame, conf: Settings = Settings(), one_part: bool = False, guard: bool = False) -> DataFrame:
    """parts(document_id, document_name, sheet_name, text and maybe part_idx), null names allowed -> one row for each chunk.

    Chunks are numbered through all parts of a document, in the order of part_idx or else of the sheets' names and texts.
    one_part: every document has one part, so that nothing needs to be shuffled. guard: chunks over the token guard are split
    before they are numbered, as guarded does with chunks made before.
    """
    cut = tx.chunks(F.col("text"), conf.chunk_size, conf.chunk_overlap)
    order = F.col("part_idx") if "part_idx" in parts.columns else F.struct(F.coalesce("sheet_name", F.lit("")), F.coalesce("text", F.lit("")))
    per_part = parts.select(
        "document_id",
        F.coalesce("document_name", F.lit(UNNAMED)).alias("document_name"),
        F.coalesce("sheet_name", F.lit("")).alias("sheet_name"),
        (F.flatten(F.transform(cut, lambda c: pieces(c, conf))) if guard else cut).alias("c"),
        *([] if one_part else [order.alias("_order")]),
    )
    if one_part:
        return per_part.select("document_id", "document_name", "sheet_name", F.posexplode("c").alias("chunk_idx", "chunk_text"))
    numbered = per_part.withColumn("_before", before(F.size("c"), "_order"))
    return numbered.select("document_id", "document_name", "sheet_name", "_before", F.posexplode("c").alias("_i", "chunk_text")).select(
        "document_id", "document_name", "sheet_name", (F.col("_before") + F.col("_i")).cast("int").alias("chunk_idx"), "chunk_text"
    )


def before(n: Column, order: str) -> Column:
    """Sum of n over the rows of the same document before this one."""
    return F.coalesce(F.sum(n).over(Window.partitionBy("document_id").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def pieces(chunk: Column, conf: Settings) -> Column:
    """A chunk, or what it is split into where it is over the token guard."""
    return F.when(tx.token_count(chunk) <= conf.chunk_tokens, F.array(chunk)).otherwise(tx.split_by_tokens(chunk, conf.chunk_tokens))


def guarded(chunks: DataFrame, conf: Settings = Settings()) -> DataFrame:
    """Chunks over the token guard are split before they are stored, so text and vector stay together, and numbered anew."""
    cut = chunks.withColumn("_pieces", pieces(F.col("chunk_text"), conf)).withColumn("_before", before(F.size("_pieces"), "chunk_idx"))
    others = [c for c in chunks.columns if c not in ("chunk_text", "chunk_idx")]
    cut = cut.select(*others, "_before", F.posexplode("_pieces").alias("_i", "chunk_text"))
    return cut.select(*others, (F.col("_before") + F.col("_i")).cast("int").alias("chunk_idx"), "chunk_text")


def chunk_table(chunks: DataFrame, embedder: Embedder | None = None) -> DataFrame:
    """Chunks with normalised text and names and a vector; a chunk without terms has none."""
    embedder = embedder or HashEmbedder()
    named = chunks.select(
        "*",
        tx.normalised(F.col("chunk_text")).alias("chunk_text_normalized"),
        F.array_join(tx.name_terms(F.col("document_name")), " ").alias("document_name_normalized"),
        F.array_join(tx.name_terms(F.col("sheet_name")), " ").alias("sheet_name_normalized"),
    )
    return named.withColumn("embedding", embedder.column(word_list("chunk_text_normalized")))


def word_list(column: str) -> Column:
    """The words of a normalised column; null where there are none."""
    return F.when(F.col(column) != "", F.split(column, " "))


def postings(table: DataFrame, column: str, key: tuple[str, ...] = CHUNK_KEY) -> DataFrame:
    """(key, term, tf, dl): the full-text index of a normalised column; one shuffle on (key, term)."""
    words = F.filter(F.split(F.col(column), " "), lambda w: w != "")
    listed = table.select(*key, words.alias("w")).select(*key, F.size("w").cast("long").alias("dl"), F.explode("w").alias("term"))
    return listed.groupBy(*key, "term").agg(F.count(F.lit(1)).alias("tf"), F.first("dl").alias("dl"))


#: Bytes of text whose postings are made and sorted at once.
BLOCK_BYTES = 16 << 20


def sorted_postings(table: DataFrame, column: str, key: tuple[str, ...] = CHUNK_KEY) -> DataFrame:
    """postings of a table whose keys are unique, without a shuffle: sorted by term within blocks of rows of a partition, so that
    pages of a Parquet file hold few terms each."""
    schema = T.StructType([*(table.schema[k] for k in key), *T._parse_datatype_string("term string, tf long, dl long").fields])

    def block(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(held).combine_chunks()
        lists = pc.split_pattern(rows[column].combine_chunks() if rows[column].num_chunks != 1 else rows[column].chunk(0), " ")
        words, at = lists.flatten(), pc.list_parent_indices(lists)
        full = pc.not_equal(words, "")
        words, at = words.filter(full).dictionary_encode(), at.filter(full).to_numpy(zero_copy_only=False)
        if not len(at):
            return
        dl, order = np.bincount(at, minlength=rows.num_rows), pc.sort_indices(words.dictionary)
        place = np.empty(len(order), np.int64)
        place[order.to_numpy(zero_copy_only=False)] = np.arange(len(order))
        pairs, tf = np.unique(place[words.indices.to_numpy(zero_copy_only=False)] * rows.num_rows + at, return_counts=True)
        terms = words.dictionary.take(order)
        for i in range(0, len(pairs), 1 << 16):
            term, row = np.divmod(pairs[i : i + (1 << 16)], rows.num_rows)
            columns = [rows[k].take(pa.array(row)).combine_chunks() for k in key] + [terms.take(pa.array(term)), pa.array(tf[i : i + (1 << 16)]), pa.array(dl[row])]
            yield pa.RecordBatch.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns], [*key, "term", "tf", "dl"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.column(column).nbytes
            if size >= BLOCK_BYTES:
                yield from block(held)
                held, size = [], 0
        if held:
            yield from block(held)

    return table.select(*key, column).mapInArrow(run, schema)


def text_stats(table: DataFrame, column: str) -> DataFrame:
    """collection_stats of a table whose keys are unique, from its texts."""
    return table.select(F.size(word_list(column)).cast("long").alias("dl")).filter("dl > 0").agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))


def collection_stats(index: DataFrame, key: tuple[str, ...] = CHUNK_KEY) -> DataFrame:
    """One row: number of indexed rows and their mean length."""
    return index.groupBy(*key).agg(F.first("dl").alias("dl")).agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))


def term_stats(index: DataFrame) -> DataFrame:
    return index.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))
