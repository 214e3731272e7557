"""SimHash near-dedup with covering locality-sensitive hashing (Pagh, 2016).

A fingerprint bit is the majority of that bit over the XXH64 values of all word shingles. For a radius r, the 2^(r+1)-1
masks m_v[i] = <code(i), v> mod 2 over non-zero v cover every set of at most r differing bits: some v is orthogonal to
the codes of all of them, so both fingerprints agree under m_v and meet in that table. No pair within the radius is lost.

Only distinct fingerprints are hashed, so exact copies and empty texts cost one row. Inside a bucket no pairs are
emitted: fingerprints within 2k bits share a point at k bits from each, so each member lists its neighbours at up to
ceil(r/2) free bits and those that share one (checked against r) are joined; one edge per member leaves the bucket.
Buckets above ``split`` members are dealt again by r + 1 parts of their free bits, one of which must agree.

Defined results: a null text counts as empty; texts without words have fingerprint 0 and link like any other; a null id is
never the smallest unless all ids of its component are null; repeated rows are rows of one component; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import Table, body, in_arrow, small_side
from .graph import components

BITS = 64


def shingles(text: bytes, k: int) -> list[bytes] | Iterator[bytes]:
    """Word k-shingles, repeats included; fewer words: the whole sequence; none: nothing. bytes.lower and bytes.split are ASCII only."""
    words = text.lower().split()
    if len(words) < k:
        return [b" ".join(words)] if words else []
    return map(b" ".join, zip(*(words[i:] for i in range(k))))


def fingerprint(text: bytes, k: int) -> int:
    """The SimHash of a text."""
    digest = xxhash.xxh64_intdigest
    return majority(np.array([digest(s, 42) for s in shingles(text, k)], dtype=np.uint64))


def majority(h: np.ndarray) -> int:
    """The bits that more than half of the hashes have, as a signed 64-bit number; 0 without hashes."""
    if not len(h):
        return 0
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(h), 1 << 15):
        ones += np.unpackbits(h[i : i + (1 << 15)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3) -> DataFrame:
    """doc_id, fp long for every row."""
    out = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("fp", T.LongType())])
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0).cast(arrow.field(0).type), pa.array([fingerprint(t.as_buffer().to_pybytes(), k) for t in b.column(1)], pa.int64())], schema=arrow)

    return in_arrow(docs.select(F.col(id_col).alias("doc_id"), body(text_col).alias("text")), run, out)


def covering_masks(radius: int) -> list[int]:
    """2^(radius + 1) - 1 masks; any `radius` bit positions are all outside at least one of them."""
    width = radius + 1
    codes = [1 + i % ((1 << width) - 1) for i in range(BITS)]
    return [sum(((c & v).bit_count() & 1) << i for i, c in enumerate(codes)) for v in range(1, 1 << width)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def hook(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least member of each of n nodes' component, for links a-b."""
    root = np.arange(n)
    while True:
        lo, hi = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        if (lo == hi).all():
            return root
        np.minimum.at(root, hi, lo)
        while (root[root] != root).any():
            root = root[root]


def bucket_links(fp: np.ndarray, free: list[int], radius: int) -> tuple[np.ndarray, np.ndarray]:
    """For members of one bucket: those whose component's first member is another, and that member."""
    n = len(fp)
    if n <= 64:
        near = np.bitwise_count(fp[:, None] ^ fp[None, :]) <= radius
        a, b = np.nonzero(np.triu(near, 1))
    else:
        points, owner = [fp], [np.arange(n)]
        for k in range(1, (radius + 1) // 2 + 1):
            for bits in combinations(free, k):
                points.append(fp ^ np.uint64(sum(1 << i for i in bits)))
                owner.append(np.arange(n))
        p, o = np.concatenate(points), np.concatenate(owner)
        by = np.argsort(p, kind="stable")
        p, o = p[by], o[by]
        if radius % 2 == 0:
            same = np.flatnonzero(p[1:] == p[:-1])
            a, b = o[same], o[same + 1]
        else:  # points at (r + 1) / 2 reach one bit too far: compare all that share a point
            first, pairs = np.flatnonzero(np.r_[True, p[1:] != p[:-1]]), []
            size = np.diff(np.r_[first, len(p)])
            for d in range(1, int(size.max())):
                i = np.flatnonzero(p[d:] == p[:-d])
                i = i[np.bitwise_count(fp[o[i]] ^ fp[o[i + d]]) <= radius]
                pairs.append(np.stack((o[i], o[i + d])))
            a, b = np.concatenate(pairs, axis=1) if pairs else (np.zeros(0, int), np.zeros(0, int))
    root = hook(n, a, b)
    moved = np.flatnonzero(root != np.arange(n))
    return fp[moved], fp[root[moved]]


def links(prints: DataFrame, radius: int = 2, split: int = 200_000) -> DataFrame:
    """prints(fp) distinct -> edges (a, b) whose components are those of all pairs within the radius."""
    masks = covering_masks(radius)
    free = [[i for i in range(BITS) if not m >> i & 1] for m in masks]
    keyed = prints.select("fp", F.explode(F.array(*[F.struct(F.lit(v).alias("v"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("key")) for v, m in enumerate(masks)])).alias("t")).select("t.v", "t.key", "fp")
    keyed = keyed.join(keyed.groupBy("v", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), ["v", "key"])
    # one part of the free bits agrees: dealt by it where a bucket is too large for one task
    parts = F.array(*[F.array(*[F.struct(F.lit(j).alias("j"), F.col("fp").bitwiseAND(F.lit(signed(sum(1 << i for i in f[j :: radius + 1])))).alias("part")) for j in range(radius + 1)]) for f in free])
    whole = F.array(F.struct(F.lit(-1).alias("j"), F.lit(0).cast("long").alias("part")))
    keyed = keyed.select("v", "key", "fp", F.explode(F.when(F.col("n") <= split, whole).otherwise(parts[F.col("v")])).alias("s")).select("v", "key", "s.j", "s.part", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def of(rows: list[np.ndarray]) -> pa.RecordBatch:
            v, key, j, part, fp = rows
            new = np.flatnonzero(np.r_[True, (v[1:] != v[:-1]) | (key[1:] != key[:-1]) | (j[1:] != j[:-1]) | (part[1:] != part[:-1])])
            ends, out = np.r_[new[1:], len(v)], []
            two = new[ends - new == 2]
            x, y = fp[two].view(np.uint64), fp[two + 1].view(np.uint64)
            near = np.bitwise_count(x ^ y) <= radius
            out.append((x[near], y[near]))
            for s, e in zip(new[ends - new > 2], ends[ends - new > 2]):
                out.append(bucket_links(np.unique(fp[s:e].view(np.uint64)), free[v[s]], radius))
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[i] for o in out]).view(np.int64)) for i in (0, 1)], names=["a", "b"])

        held: list[np.ndarray] | None = None
        for b in batches:
            rows = [c.to_numpy() for c in b.columns]
            if held is not None:
                rows = [np.concatenate(x) for x in zip(held, rows)]
            same = (rows[0] == rows[0][-1]) & (rows[1] == rows[1][-1]) & (rows[2] == rows[2][-1]) & (rows[3] == rows[3][-1])
            cut = int(np.argmax(same))  # the last group may go on in the next batch
            if cut:
                yield of([r[:cut] for r in rows])
            held = [r[cut:] for r in rows]
        if held is not None and len(held[0]):
            yield of(held)

    keys = ["v", "key", "j", "part"]
    return in_arrow(keyed.repartition(*keys).sortWithinPartitions(*keys), run, "a long, b long").distinct()


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3, radius: int = 2) -> DataFrame:
    """One row per row of docs: doc_id, fingerprint (16 hex digits), component_id (smallest id reachable by links)."""
    prints = Table(fingerprints(docs, id_col, text_col, k), "prints").df
    classes = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(links(classes.select("fp"), radius))
    classes = classes.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    named = classes.join(least, "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")

