"""Shared helpers: scratch tables, Arrow maps, text normalisation in Spark, and byte views of Arrow text columns."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; a temporary one only where that is unset and Spark runs in one process."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="loam-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


class Table:
    """A DataFrame written as Parquet to the shared folder; reading it needs no lineage of the job that made it."""

    def __init__(self, df: DataFrame, tag: str):
        self.spark = df.sparkSession
        self.path = f"{scratch_dir(self.spark)}/loam-{tag}-{uuid.uuid4().hex}"
        df.write.parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        """Delete the files; only for tables that no returned plan reads."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: Bytes of rows sent to a Python worker at once.
ARROW_BYTES = 4 << 20


def give_back() -> None:
    """Memory that Arrow and the C library hold free goes back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def settle(spark: SparkSession, executors: bool = False) -> None:
    """Between the rounds of a long operator: the driver frees what finished rounds left, and with their handles Spark
    removes their shuffle files and broadcasts, which otherwise stay until the driver happens to collect its garbage.

    executors: between stages, the executors collect theirs too, by a job of a few tasks for each core, so that the heap that a
    JVM stage filled shrinks before Python workers need memory beside it.
    """
    if executors:
        tasks = 2 * spark.sparkContext.defaultParallelism
        spark.range(0, tasks, 1, tasks).select(F.expr("java_method('java.lang.System', 'gc')").alias("done")).filter("done is null").count()
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    give_back()


def in_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: object) -> DataFrame:
    """df.mapInArrow(run, schema) in batches of at most some ARROW_BYTES; a worker, which waits for its next task with what it
    holds, gives its free memory back at the end of a partition. The batch size is set in the session unless it was already."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if df.sparkSession.conf.get(name, "67108864b") in ("67108864b", "67108864", "64m", "64MB"):
        df.sparkSession.conf.set(name, str(ARROW_BYTES))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return df.mapInArrow(whole, schema)


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, UPPER, UPPER.lower())


def body(text_col: str) -> Column:
    """The text; null counts as empty."""
    return F.coalesce(F.col(text_col), F.lit(""))


#: A side of a join is broadcast only when its counted rows stay below this; beyond it Spark shuffles both sides.
BROADCAST_ROWS = 1_000_000


def small_side(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    return F.broadcast(df) if rows <= limit else df


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(UTF-8 bytes of all rows, n + 1 offsets) of a string column; null counts as empty. Copies nothing but for nulls."""
    if col.null_count:
        col = pc.fill_null(col, "")
    wide = pa.types.is_large_string(col.type)
    _, offsets, data = col.buffers()
    n = len(col)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[col.offset : col.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def row_slices(off: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `most` bytes each; a longer row stands alone."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def blocks(batches: Iterator[pa.RecordBatch], text: str, most: int = 1 << 19) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, their bytes, their offsets) in pieces of about `most` bytes of text, whatever the batch size."""
    for batch in batches:
        data, off = text_bytes(batch.column(batch.schema.get_field_index(text)))
        for i, j in row_slices(off, most):
            yield batch.slice(i, j - i), data[off[i] : off[j]], off[i : j + 1] - off[i]


def segment_sum(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sum of values[off[i]:off[i + 1]] for each i; empty ranges give 0."""
    total = np.concatenate(([0.0], np.cumsum(values, dtype=np.float64)))
    return total[off[1:]] - total[off[:-1]]


def arrow_out(schema: pa.Schema, *columns: object) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema)
