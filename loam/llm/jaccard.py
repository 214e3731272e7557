"""Near copies by word shingles: covering SimHash first, then all pairs of a given Jaccard similarity.

Texts are sets of XXH64 values of their k-word shingles; equal sets count once. The covering tables of simhash.py find the pairs
whose SimHash of these shingles differs in a few bits. A similarity of 0.8, however, is some ten of 64 bits, which no affordable number
of tables covers. So the sets decide: what the tables find is verified by them, and the pairs that the tables cannot reach
are found by prefix filtering (Chaudhuri et al., 2006; Xiao et al., 2008): two sets of similarity num/den or more share one of the first
n - ceil(n num/den) + 1 members of each, in any order common to all sets. Here shingles that are frequent in a sample come
last, so few texts meet under a shingle; the sample decides the order only, no pair is lost by it. Lengths and places in
the order bound the overlap of a pair; what the bounds leave is compared set by set.

Pairs are made in steps, so that a large group does not meet pair by pair: those of the tables; then each text of a shingle
with the CENTRES least ones, the same ones for all shingles of a group; then each text that these have not joined to its shingle's largest group with SOME
others of each shingle; then all pairs of a shingle that the verified pairs have not joined yet.

Defined results: as in simhash.py for ids and repeated rows; a null text counts as empty, and texts without words are
copies of each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import Table, body, in_arrow, settle, small_side
from .graph import components
from .simhash import links, majority, shingles

SAMPLE = 20_000
#: Shingles of the sample that are put last, the most frequent ones first to be so.
FREQUENT = 500_000
#: Texts of a shingle that all its others are compared with before all pairs are.
CENTRES = 8
#: Texts of each shingle that a text not yet joined to the shingle's largest group is compared with next.
SOME = 32
#: Texts to a bucket of prefix members, by which the number of buckets grows.
BUCKET_TEXTS = 2_000

MEMBERS = pa.schema([("h", pa.int64()), ("own", pa.int32()), ("pos", pa.int32())])
OWNERS = pa.schema([("cls", pa.int64()), ("n", pa.int32())])
ROWS = "h long, cls long, n int, pos int, least long"


def hashes(text: bytes, k: int) -> np.ndarray:
    """XXH64 of each shingle, repeats included."""
    digest = xxhash.xxh64_intdigest
    return np.array([digest(s, 42) for s in shingles(text, k)], dtype=np.uint64)


def shingle_set(text: bytes, k: int) -> np.ndarray:
    """Distinct shingle hashes, ascending."""
    return np.unique(hashes(text, k))


def set_class(members: np.ndarray) -> int:
    """A signed 64-bit number of the set."""
    return int(np.array([xxhash.xxh64_intdigest(members.tobytes(), 7)], np.uint64).view(np.int64)[0])


def classes(docs: DataFrame, k: int) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, tag, cls, fp): tag a hash of the text, cls of its shingle set, fp its SimHash."""
    out = T.StructType([docs.schema["doc_id"], *(T.StructField(c, T.LongType()) for c in ("tag", "cls", "fp"))])
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [hashes(t.as_buffer().to_pybytes(), k) for t in b.column(2)]
            facts = [pa.array([f(h) for h in found], pa.int64()) for f in (lambda h: set_class(np.unique(h)), majority)]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(arrow.field(0).type), b.column(1), *facts], schema=arrow)

    return in_arrow(docs.select("doc_id", F.xxhash64("text").alias("tag"), "text"), run, out)


def frequent(docs: DataFrame, rows: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes ascending, counts) of shingles in more than one of some SAMPLE texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingle_set(t.as_buffer().to_pybytes(), k) for t in b.column(0)]
            h, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *sets]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], names=["h", "n"])

    some = docs.filter(F.pmod(F.xxhash64(F.lit(1), "text"), F.lit(max(1, rows // SAMPLE))) == 0).select("text")
    got = in_arrow(some, run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).filter("n > 1").orderBy(F.desc("n")).limit(FREQUENT).toArrow()
    h = got["h"].to_numpy().view(np.uint64)
    by = np.argsort(h)
    return h[by], got["n"].to_numpy()[by].astype(np.int32)


def message(*tables: pa.RecordBatch) -> list[bytes]:
    out = []
    for t in tables:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, t.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
            w.write_batch(t)
        out.append(sink.getvalue().to_pybytes())
    return out


def prefixes(docs: DataFrame, order: object, k: int, num: int, den: int, buckets: int) -> DataFrame:
    """docs(text) -> (bucket, members, owners): the first members of each set in the common order, dealt by their hash, as compressed messages."""

    def packed(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        h, own, pos = (np.concatenate([x[i] for x in held]) for i in range(3))
        cls, n = (np.array([x[i] for x in held]) for i in (3, 4))
        bucket = (h.view(np.uint64) % np.uint64(buckets)).astype(np.int32)
        by = np.lexsort((h, bucket))
        cuts = np.flatnonzero(np.r_[True, np.diff(bucket[by]) != 0])
        out: list[list] = [[], [], []]
        for a, b in zip(cuts, np.r_[cuts[1:], len(by)]):
            some = by[a:b]
            owners, local = np.unique(own[some], return_inverse=True)
            members = pa.record_batch([pa.array(h[some]), pa.array(local.astype(np.int32)), pa.array(pos[some])], schema=MEMBERS)
            for x, y in zip(out, (int(bucket[some[0]]), *message(members, pa.record_batch([pa.array(cls[owners]), pa.array(n[owners].astype(np.int32))], schema=OWNERS)))):
                x.append(y)
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), *(pa.array(x, pa.binary()) for x in out[1:])], names=["bucket", "members", "owners"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts = order.value
        held, size = [], 0
        for b in batches:
            for t in b.column(0):
                s = shingle_set(t.as_buffer().to_pybytes(), k)
                n = len(s)
                if not n:
                    continue
                cls = set_class(s)
                if len(known):
                    at = np.minimum(np.searchsorted(known, s), len(known) - 1)
                    s = s[np.argsort(np.where(known[at] == s, counts[at], 0), kind="stable")]
                m = n - -(-num * n // den) + 1
                held.append((s[:m].view(np.int64), np.full(m, len(held), np.int32), np.arange(m, dtype=np.int32), cls, n))
                size += m
                if size > 1 << 18:
                    yield from packed(held)
                    held, size = [], 0
        if held:
            yield from packed(held)

    return in_arrow(docs, run, "bucket int, members binary, owners binary")


def shared(messages: DataFrame) -> DataFrame:
    """Prefix members that are in the prefix of another set too: (h, cls, n, pos, least), the last the least class that has h."""

    def of(held: list[tuple]) -> pa.RecordBatch:
        h, pos = (np.concatenate([m.column(c).to_numpy() for m, _ in held]) for c in (0, 2))
        cls, n = (np.concatenate([o.column(c).to_numpy()[m.column(1).to_numpy()] for m, o in held]) for c in (0, 1))
        by = np.lexsort((cls, h))
        h, cls, n, pos = h[by], cls[by], n[by], pos[by]
        new = np.r_[True, (h[1:] != h[:-1]) | (cls[1:] != cls[:-1])]
        h, cls, n, pos = h[new], cls[new], n[new], pos[new]
        same = h[1:] == h[:-1]
        more = np.r_[same, False] | np.r_[False, same]
        first = np.flatnonzero(np.r_[True, ~same])
        least = np.repeat(cls[first], np.diff(np.r_[first, len(h)]))
        return pa.RecordBatch.from_arrays([pa.array(c[more]) for c in (h, cls, n, pos, least)], names=["h", "cls", "n", "pos", "least"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for b in batches:
            for bucket, *blobs in zip(b.column(0).to_pylist(), b.column(1), b.column(2)):
                if held and bucket != now:
                    yield of(held)
                    held = []
                now = bucket
                held.append(tuple(pa.ipc.open_stream(x.as_buffer()).read_next_batch() for x in blobs))
        if held:
            yield of(held)

    return in_arrow(messages.repartition("bucket").sortWithinPartitions("bucket"), run, ROWS)


def whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Columns of rows sorted by the first one, cut between its values."""
    held: list[np.ndarray] | None = None
    for b in batches:
        if not b.num_rows:
            continue
        rows = [c.to_numpy() for c in b.columns]
        if held is not None:
            rows = [np.concatenate(x) for x in zip(held, rows)]
        cut = int(np.searchsorted(rows[0], rows[0][-1]))  # the last group may go on in the next batch
        if cut:
            yield [r[:cut] for r in rows]
        held = [r[cut:] for r in rows]
    if held is not None:
        yield held


def in_groups(rows: DataFrame, pairs_of: object, num: int, den: int, least: int = 500_000) -> DataFrame:
    """rows(h, cls, n, pos, least, root) -> (a, b), a < b, of what pairs_of names by row numbers, if the bounds allow it and the roots differ.

    Shingles with the same least class, mostly those of one group of texts, go to one of four tasks, which names a pair about once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def distinct(held: list[np.ndarray]) -> np.ndarray:
            return np.unique(np.concatenate(held, axis=1), axis=1) if held else np.zeros((2, 0), np.int64)

        for _, h, cls, n, pos, root in whole_groups(batches):
            held, size = [], 0
            for i, j in pairs_of(h, root):
                most = np.minimum(n[i] - pos[i], n[j] - pos[j])  # that can be common from here on
                fits = (most.astype(np.int64) * (num + den) >= num * (n[i].astype(np.int64) + n[j])) & (root[i] != root[j])
                x, y = cls[i[fits]], cls[j[fits]]
                held.append(np.stack((np.minimum(x, y), np.maximum(x, y))))
                size += len(x)
                if size > least:
                    held = [distinct(held)]
                    size = 0
            both = distinct(held)
            yield pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], names=["a", "b"])

    keyed = rows.select(F.xxhash64("least", F.pmod("h", F.lit(4))).alias("key"), "h", "cls", "n", "pos", "root")
    return in_arrow(keyed.repartition("key").sortWithinPartitions("key", "h", "cls"), run, "a long, b long").distinct()


def with_centres(h: np.ndarray, root: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of each shingle the CENTRES least classes with all others."""
    first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
    start = np.repeat(first, np.diff(np.r_[first, len(h)]))
    every = np.arange(len(h))
    for c in range(CENTRES):
        others = every[every > start + c]
        yield start[others] + c, others


def root_runs(h: np.ndarray, root: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(order of the rows by shingle and root; first and size of each run of one root; shingle's number of each run; the largest run of each shingle)."""
    by = np.lexsort((root, h))
    h, root = h[by], root[by]
    first = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (root[1:] != root[:-1])])
    size = np.diff(np.r_[first, len(h)])
    shingle = np.cumsum(np.r_[False, h[first][1:] != h[first][:-1]])
    largest = np.lexsort((-size, shingle))[np.flatnonzero(np.r_[True, np.diff(shingle) != 0])]
    return by, first, size, shingle, largest


def with_some(h: np.ndarray, root: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Each row that is not of its shingle's most frequent root with SOME rows of the shingle, drawn by their hashes: of each shingle
    that two texts share others, so that a text that is near to a small part of a large group soon meets one of these."""
    by, first, size, shingle, largest = root_runs(h, root)
    minor = np.ones(len(first), bool)
    minor[largest] = False
    total = np.bincount(shingle, size).astype(np.int64)
    start = first[np.flatnonzero(np.r_[True, np.diff(shingle) != 0])]
    row = np.flatnonzero(np.repeat(minor, size))
    of = np.repeat(shingle, size)[row]
    draw = (h[by[row]].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ row.astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(20)
    for k in range(SOME):
        other = start[of] + ((draw + np.uint64(k * 0x9E3779B1)) % total[of].astype(np.uint64)).astype(np.int64)
        yield by[row], by[other]


def with_other_roots(h: np.ndarray, root: np.ndarray, at_once: int = 1_000_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of a shingle whose roots differ: each row that is not of the shingle's most frequent root with all its rows."""
    by, first, size, shingle, largest = root_runs(h, root)
    group = np.flatnonzero(np.r_[True, np.diff(shingle) != 0])
    runs = np.diff(np.r_[group, len(first)])
    for g, r, main in zip(group[runs > 1], runs[runs > 1], largest[runs > 1]):
        lo, hi = first[g], first[g + r - 1] + size[g + r - 1]
        minor = np.r_[lo : first[main], first[main] + size[main] : hi]
        for part in np.array_split(minor, 1 + len(minor) * (hi - lo) // at_once):
            yield by[np.repeat(part, hi - lo)], by[np.tile(np.arange(lo, hi), len(part))]


def verified(pairs: DataFrame, docs: DataFrame, reps: DataFrame, k: int, num: int, den: int) -> Table:
    """pairs(a, b) whose sets have a similarity of num/den or more; docs(doc_id, text, tag), reps(cls, tag)."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, np.ndarray] = {}
        size = 0

        def members(cls: int, text: pa.Scalar) -> np.ndarray:
            nonlocal size
            if cls not in known:
                if size > 16 << 20:
                    known.clear()
                    size = 0
                known[cls] = shingle_set(text.as_buffer().to_pybytes(), k)
                size += known[cls].nbytes
            return known[cls]

        for b in batches:
            keep = []
            for c, d, x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3)):
                x, y = members(c, x), members(d, y)
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(common * (num + den) >= num * (len(x) + len(y)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    wanted = Table(pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct().join(reps, "cls"), "wanted")
    texts = docs.join(small_side(wanted.df, wanted.df.count()), "tag").select("cls", "text")
    held = Table(texts.dropDuplicates(["cls"]), "texts")
    a, b = held.df.toDF("a", "x"), held.df.toDF("b", "y")
    near = Table(in_arrow(pairs.join(a, "a").join(b, "b").select("a", "b", "x", "y"), check, "a long, b long"), "near")
    wanted.drop(), held.drop()
    return near


def rooted(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """rows with the root of their class."""
    roots = small_side(roots, roots.count())
    return rows.join(roots.select(F.col("node").alias("cls"), "root"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, similarity: tuple[int, int] = (4, 5), radius: int = 3) -> DataFrame:
    """docs without the rows whose id is not the smallest of those reachable by pairs of at least that similarity; rows that repeat an id stay together.

    radius: differing bits of a SimHash that the covering tables reach.
    """
    num, den = similarity
    own = docs.select(F.col(id_col).alias("doc_id"), body(text_col).alias("text"))
    groups = Table(classes(own, k), "classes").df
    # one text for each class; the others are left out of the search
    row = F.struct("doc_id", "tag")
    reps = Table(groups.groupBy("cls").agg(F.min(row).alias("own"), F.min("doc_id").alias("least"), F.min("fp").alias("fp")).select("cls", "own", "own.tag", "least", "fp"), "reps")
    others = Table(groups.join(reps.df.select("cls", "own"), "cls").filter(~row.eqNullSafe(F.col("own"))).select(F.col("doc_id").alias("_id"), F.col("tag").alias("_tag")).distinct(), "others")
    tagged = own.withColumn("tag", F.xxhash64("text"))
    single = tagged.join(small_side(others.df, others.df.count()), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("tag") == F.col("_tag")), "left_anti")
    tags = reps.df.select("cls", "tag")
    scrap = [others]

    tested: list[DataFrame] = []

    def joined(pairs: DataFrame, edges: DataFrame | None) -> DataFrame:
        """The links known so far with those pairs that are near; pairs that were compared before are not compared again."""
        for before in tested:
            pairs = pairs.join(before, ["a", "b"], "left_anti")
        table = Table(pairs, "pairs")
        tested.append(table.df)
        near = verified(table.df, single, tags, k, num, den)
        scrap.extend((table, near))
        settle(docs.sparkSession)
        return near.df if edges is None else edges.unionByName(near.df)

    # what the covering tables find: links of fingerprints, by the least class of each
    prints = reps.df.groupBy("fp").agg(F.min("cls").alias("cls"))
    near_prints = links(prints.select("fp"), radius)
    ends = near_prints.join(prints.toDF("a", "ca"), "a").join(prints.toDF("b", "cb"), "b").select("ca", "cb")
    same = reps.df.join(prints.toDF("fp", "least_cls"), "fp").filter("cls <> least_cls").select("cls", "least_cls")
    tables = ends.toDF("x", "y").unionByName(same.toDF("x", "y")).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    edges = joined(tables, None)

    # what they cannot reach
    settle(docs.sparkSession, executors=True)
    order = docs.sparkSession.sparkContext.broadcast(frequent(own, groups.count(), k))
    buckets = max(4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-groups.count() // BUCKET_TEXTS))
    rows = Table(shared(prefixes(single.select("text"), order, k, num, den, buckets)), "shared")
    scrap.append(rows)
    roots = Table(components(edges), "roots")
    for pairs_of in (with_centres, with_some, with_other_roots):
        scrap.append(roots)
        known, edges = edges, joined(in_groups(rooted(rows.df, roots.df), pairs_of, num, den), edges)
        if scrap[-1].df.isEmpty():
            edges = known  # nothing new, so the roots stay
        else:
            roots = Table(components(edges), "roots")

    named = rooted(reps.df, roots.df)
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.join(least, "root").select("cls", "component_id")
    losers = Table(groups.join(named, "cls").filter("doc_id <> component_id").select("doc_id").distinct(), "losers").df
    for table in {t.path: t for t in (*scrap, roots, reps)}.values():
        table.drop()
    losers = small_side(losers, losers.count())
    return docs.join(losers, docs[id_col] == losers["doc_id"], "left_anti")
