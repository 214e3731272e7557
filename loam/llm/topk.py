"""Exact top-k inner-product search by Fagin's threshold algorithm over sorted per-dimension lists.

Candidates are dealt into blocks of a fixed size and queries into blocks of a fixed size; each pair of blocks is one task.
A task sorts its candidates once per dimension. For a query it reads all lists in step, best contribution first, scores
each newly seen candidate in full, and stops once the sum of the contributions at the current depth, which no unseen candidate
can exceed, is below the kth score found. Block winners are merged by a window over each query.

Defined results: a vector that is null, empty, or holds a null or non-finite component takes no part; only vectors of
equal length are compared; rows that repeat both id and vector count once; rows with the query's own id are no
candidates; null ids take no part; ties go to the smaller id; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def quantised(vector: Column, scale: int = 1024) -> Column:
    """floor(scale * x) of every component, x as double."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * float(scale)).cast("long"))


def usable(vector: Column) -> Column:
    return vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))


class SortedLists:
    """Per-dimension lists of one candidate block."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        by = np.argsort(ids, kind="stable")
        self.ids, self.v = ids[by], vectors[by].astype(np.float64)  # exact: products and sums stay below 2^53
        self.order = np.argsort(self.v, axis=0, kind="stable").astype(np.int32)

    def search(self, query_id: int, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the k best, ties to the smaller id. The query's own id is skipped."""
        n = len(self.ids)
        lists = np.flatnonzero(q)
        up = q[lists] > 0
        seen = self.ids == query_id
        best, score = np.zeros(0, np.int64), np.zeros(0)
        depth, step = 0, 32
        while depth < n:
            to = min(n, depth + step)
            rows = np.where(up, self.order[n - to : n - depth][::-1][:, lists], self.order[depth:to][:, lists])
            new = np.zeros(n, bool)
            new[rows.ravel()] = True
            if not len(lists):
                new[:] = True
            new = np.flatnonzero(new & ~seen)
            seen[new] = True
            best, score = np.r_[best, new], np.r_[score, self.v[new] @ q]
            if len(best) > k:
                top = np.lexsort((best, -score))[:k]
                best, score = best[top], score[top]
            bound = float(self.v[rows[-1], lists] @ q[lists])
            if not len(lists) or len(best) == k and score[-1] > bound:
                break
            depth, step = to, step * 2
        top = np.lexsort((best, -score))[:k]
        return self.ids[best[top]], score[top].astype(np.int64)


def block_search(k: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(cand: pa.Table, query: pa.Table) -> pa.Table:
        out: list[list] = [[], [], []]
        if cand.num_rows and query.num_rows:
            lists = SortedLists(cand["vec_id"].to_numpy(), matrix(cand["v"]))
            for qid, q in zip(query["vec_id"].to_numpy(), matrix(query["v"]).astype(np.float64)):
                ids, score = lists.search(qid, q, k)
                out[0].append(np.full(len(ids), qid)), out[1].append(ids), out[2].append(score)
        return pa.table({n: pa.array(np.concatenate(x) if x else [], pa.int64()) for n, x in zip(("query_id", "vec_id", "score"), out)})

    return run


def matrix(col: pa.ChunkedArray) -> np.ndarray:
    return np.stack(col.combine_chunks().to_numpy(zero_copy_only=False))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, block: int = 16_384, query_block: int = 2_048) -> DataFrame:
    """vectors and queries: vec_id long, v array<long> -> query_id, rank, vec_id, score. Exact at every size."""
    vectors = vectors.filter("vec_id is not null").dropDuplicates(["vec_id", "v"])
    queries = queries.filter("vec_id is not null").dropDuplicates(["vec_id", "v"])
    n, m = -(-vectors.count() // block) or 1, -(-queries.count() // query_block) or 1
    deal = lambda parts: F.pmod(F.xxhash64("vec_id", "v"), F.lit(parts)).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    vectors = vectors.select("vec_id", "v", F.size("v").alias("d"), deal(n).alias("b"), every(m).alias("qb"))
    queries = queries.select("vec_id", "v", F.size("v").alias("d"), deal(m).alias("qb"), every(n).alias("b"))
    keys = ["b", "qb", "d"]
    found = vectors.groupBy(*keys).cogroup(queries.groupBy(*keys)).applyInArrow(block_search(k), "query_id long, vec_id long, score long")
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.distinct().withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
