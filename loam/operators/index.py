"""The stored index: chunks, postings and collection statistics as Parquet under one folder, built by one scan of the parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Settings
from ..models import Embedder
from .ingest import chunk_documents, chunk_table, collection_stats, postings, sorted_postings, term_stats, text_stats

#: Normalised columns that have postings.
FIELDS = {"content": "chunk_text_normalized", "name": "document_name_normalized", "sheet": "sheet_name_normalized"}


class Index:
    """Tables chunks, postings (a folder for each field, in blocks of chunks whose rows are sorted by term, so that a question
    reads the pages of its own terms), stats and terms."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def read(self, table: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{table}")

    def build(self, parts: DataFrame, conf: Settings = Settings(), embedder: Embedder | None = None, one_part: bool = False) -> Index:
        """Write all tables anew; parts are read once, the rest is made from the stored chunks."""
        chunk_table(chunk_documents(parts, conf, one_part), embedder).write.mode("overwrite").parquet(f"{self.root}/chunks")
        chunks = self.read("chunks")
        # ids that come again share chunk numbers: their chunks are counted together
        unique = chunks.filter("chunk_idx = 0").groupBy("document_id").count().filter("count > 1").isEmpty()
        for field, column in FIELDS.items():
            found = sorted_postings(chunks, column) if unique else postings(chunks, column).sortWithinPartitions("term")
            found.write.mode("overwrite").parquet(f"{self.root}/postings/{field}")
            stats = text_stats(chunks, column) if unique else collection_stats(self.read(f"postings/{field}"))
            stats.write.mode("overwrite").parquet(f"{self.root}/stats/{field}")
        term_stats(self.read("postings/content")).write.mode("overwrite").parquet(f"{self.root}/terms")
        return self

    def chunks(self, document_ids: list | None = None) -> DataFrame:
        return self._of(self.read("chunks"), document_ids)

    def field(self, name: str, terms: list[str], document_ids: list | None = None) -> tuple[DataFrame, DataFrame]:
        """(postings of the terms, statistics of the collection) of a field; with ids, those of their documents."""
        index = self.read(f"postings/{name}")
        stats = self.read(f"stats/{name}") if not document_ids else collection_stats(self._of(index, document_ids))
        return self._of(index.filter(F.col("term").isin(terms)), document_ids), stats

    def _of(self, df: DataFrame, document_ids: list | None) -> DataFrame:
        return df.filter(F.col("document_id").isin(document_ids)) if document_ids else df
