"""The document catalogue: an append-only log of states, and the current row of each document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The states of a document.
STATES = ("PENDING", "PROCESSING", "COMPLETED", "FAILED")
SCHEMA = "id string, file_name string, content_type string, status string, file_size_bytes long, content_length long, part_count int, chunk_count int, processing_time_seconds double, created_at timestamp, updated_at timestamp"


class NotFound(LookupError):
    """No such document."""


def current(log: DataFrame) -> DataFrame:
    """Each document's last row by updated_at, then by the order of states."""
    place = F.array_position(F.array(*map(F.lit, STATES)), F.col("status"))
    w = Window.partitionBy("id").orderBy(F.desc_nulls_last("updated_at"), F.desc(place))
    return log.filter(F.col("status").isin(*STATES)).withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def listed(catalogue: DataFrame) -> DataFrame:
    return catalogue.orderBy(F.desc("created_at"), "id")


def updated(catalogue: DataFrame, changes: DataFrame) -> DataFrame:
    """Rows with the non-null values of changes(id, ...) laid over them."""
    fresh = changes.columns
    c = changes.toDF(*(f"_{x}" for x in fresh))
    joined = catalogue.join(c, catalogue["id"] == c["_id"], "left")
    return joined.select(*(F.coalesce(f"_{x}", x).alias(x) if x in fresh and x != "id" else F.col(x) for x in catalogue.columns))


def without(table: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """A table without the rows of deleted documents; gone(id)."""
    return table.join(gone.select(F.col("id").alias(key)).distinct(), key, "left_anti")


def metrics(parts: DataFrame, chunks: DataFrame) -> DataFrame:
    """(document_id, content_length, part_count, chunk_count): characters, not parts, are the length."""
    p = parts.groupBy("document_id").agg(F.sum(F.length(F.coalesce("text", F.lit("")))).alias("content_length"), F.count(F.lit(1)).alias("part_count"))
    c = chunks.groupBy("document_id").agg(F.count(F.lit(1)).alias("chunk_count"))
    return p.join(c, "document_id", "left").withColumn("chunk_count", F.coalesce("chunk_count", F.lit(0)))


class Store:
    """Catalogue and chunk tables under one folder; every change rewrites or appends whole tables."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def exists(self, table: str) -> bool:
        """Whether the table is there; one that a crash left aside during replace is put back."""
        fs, now, aside = self._fs(table), self._hadoop(table), self._hadoop(f"_old_{table}")
        if not fs.exists(now) and fs.exists(aside):
            fs.rename(aside, now)
        return fs.exists(now)

    def _hadoop(self, table: str) -> object:
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path(table))

    def _fs(self, table: str) -> object:
        return self._hadoop(table).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def tables(self) -> list[str]:
        return [t for t in ("catalogue", "chunks", "entities", "mentions", "contains", "relations") if self.exists(t)]

    def read(self, table: str) -> DataFrame:
        return self.spark.read.parquet(self.path(table))

    def append(self, table: str, rows: DataFrame) -> None:
        rows.write.mode("append").parquet(self.path(table))

    def replace(self, table: str, rows: DataFrame) -> None:
        """Written beside the old table, which goes aside before the new one takes its name and is deleted last."""
        rows.write.mode("overwrite").parquet(self.path(f"_{table}"))
        fs, now, aside = self._fs(table), self._hadoop(table), self._hadoop(f"_old_{table}")
        fs.delete(aside, True)
        fs.rename(now, aside)
        fs.rename(self._hadoop(f"_{table}"), now)
        fs.delete(aside, True)
        self.spark.catalog.refreshByPath(self.path(table))

    def delete(self, file_name: str | None = None) -> int:
        """Delete all documents of that name, or everything, with their chunks and graph rows; NotFound for an unknown name."""
        log = self.read("catalogue")
        gone = (log if file_name is None else log.filter(F.col("file_name") == file_name)).select("id").distinct()
        n = gone.count()
        if file_name is not None and not n:
            raise NotFound(file_name)
        ids = gone.select(F.col("id").cast("string").alias("id"))
        # edges first, by the nodes that are still there; the catalogue last, so that a broken deletion can be run again
        for table, key, nodes, of in (("mentions", "src", "contains", "dst"), ("relations", "src", "entities", "id")):
            if self.exists(table) and self.exists(nodes):
                owner = "src" if nodes == "contains" else "document_id"
                lost = self.read(nodes).join(ids.withColumnRenamed("id", owner), owner, "left_semi").select(F.col(of).alias("id"))
                self.replace(table, without(self.read(table), lost, key))
        for table, key in (("contains", "src"), ("entities", "document_id"), ("chunks", "document_id"), ("catalogue", "id")):
            if self.exists(table):
                self.replace(table, without(self.read(table), ids, key))
        return n
