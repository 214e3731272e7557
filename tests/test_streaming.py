"""The stream over tables that are one file or a folder of files, against the batch query."""

import pytest

from loam.plans.queries import QUERIES


@pytest.mark.parametrize("files", [None, 1, 7])
def test_stream_gives_what_the_batch_gives(spark, tmp_path, files):
    """files: None for one plain file, else the number of files in a folder; seven take two batches. An id that comes again stays."""
    rows = [(i % 9, f"Anreon met Thndor {i}. It rained.", "src1") for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    if files:
        df.repartition(files).write.parquet(f"{tmp_path}/documents.parquet")
    else:
        df.toPandas().to_parquet(f"{tmp_path}/documents.parquet")
    got, want = (sorted(map(tuple, QUERIES[q](spark, str(tmp_path)).collect())) for q in ("ingest_stream", "chunk_pack"))
    assert got == want and len(got) == 20
