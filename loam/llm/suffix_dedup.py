"""Removal of repeated byte strings by column-wise construction of collection Burrows-Wheeler transforms.

Every string of ``width`` bytes holds an anchor: the leftmost least of the hashes of its KEY-byte substrings. Equal
strings have equal anchors at equal places, so a string can repeat only among those of its anchor's hash. Neighbouring strings that
share an anchor form a segment of at most 2 * width - KEY bytes. This selects what is worth indexing: segments whose anchor
hash occurs once are left out (a filter whose size follows the number of repeated hashes), and of equal segments
only the earliest goes on, the others are marked whole; in a map task first, so that a passage that very many documents share
reaches the shuffle about once a task, then in its bucket.

The distinct segments that share anchors are indexed by batches (``CollectionTransform``). All are aligned on their anchors,
and in each round one symbol of every segment is inserted, from the last column to the first: the symbols are written where
the suffixes made so far stand, the new suffixes' places follow from the counts of their symbols before those places, and their common
prefixes with both neighbours from the least of those in between. The transform and the common prefixes of all suffixes of the batch lie in
files that each round reads and writes once from start to end; memory holds a few numbers a segment and one piece of the files. Neighbours with a common
prefix of ``width`` are equal strings: the earliest stays, the others are marked.

Defined results: a null text counts as empty; ids order the documents (null first), rows with equal ids by a hash of
their text; rows that repeat both are one document and get the same result; texts shorter than ``width`` lose nothing;
an empty table gives an empty result; further columns of the input are not read. ``width`` is KEY to 141, so that a common prefix fits a byte.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from typing import BinaryIO

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import Table, blocks, body, in_arrow, row_slices, settle, small_side, text_bytes

KEY = 28
#: Bytes of text worked on at once, so that the arrays over them stay in the processor's cache; longer texts are cut.
CACHED = 1 << 18
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
#: Stands for "no symbol"; no byte of UTF-8 text has this value.
NONE = 0xFF
#: Bits of the place in an anchor's comparison number; the others are the upper ones of its hash, the same for all texts.
PLACE = 32


class Powers:
    """Powers of the hash base and of its inverse mod 2^64, as many as were needed so far."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            self.up = np.cumprod(np.r_[np.uint64(1), np.full(n - 1, BASE, np.uint64)], dtype=np.uint64)
            self.down = np.cumprod(np.r_[np.uint64(1), np.full(n - 1, INVERSE, np.uint64)], dtype=np.uint64)
        return self.up[:n], self.down[:n]


_powers = Powers()


def key_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the KEY bytes from each position."""
    n = len(data)
    up, down = _powers(n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up, out=total[1:])
    h = (total[KEY:] - total[:-KEY]) * down[: n - KEY + 1]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    return h


def anchor_runs(data: np.ndarray, off: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, anchor, first start, last start) of the runs of width-byte strings that share an anchor; none crosses texts."""
    if len(data) < width:
        return tuple(np.zeros(0, t) for t in (np.uint64, np.int64, np.int64, np.int64))
    h = key_hashes(data)
    span, have = width - KEY + 1, 1  # keys in a string
    least = h & np.uint64((1 << 64) - (1 << PLACE)) | np.arange(len(h), dtype=np.uint64)  # of equal hashes the leftmost
    while have < span:
        step = min(have, span - have)
        least = np.minimum(least[:-step], least[step:])
        have += step
    at = (least & np.uint64((1 << PLACE) - 1)).astype(np.int64)
    # strings that lie within one text
    inside = np.zeros(len(data) + 1, np.int32)
    size = np.diff(off)
    long = size >= width
    np.add.at(inside, off[:-1][long], 1)
    np.add.at(inside, off[1:][long] - width + 1, -1)
    valid = np.cumsum(inside)[: len(at)] > 0
    starts = np.flatnonzero(valid)
    if not len(starts):
        return tuple(np.zeros(0, t) for t in (np.uint64, np.int64, np.int64, np.int64))
    a = at[starts]
    first = np.flatnonzero(np.r_[True, a[1:] != a[:-1]])
    last = np.r_[first[1:] - 1, len(a) - 1]
    return h[a[first]], a[first].astype(np.int64), starts[first], starts[last]


def cut_bytes(data: np.ndarray, lo: np.ndarray, size: np.ndarray) -> pa.Array:
    """data[lo:lo + size] of each as a binary array."""
    ends = np.cumsum(size)
    index = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(lo - (ends - size), size)
    return pa.Array.from_buffers(pa.binary(), len(lo), [None, pa.py_buffer(np.r_[0, ends].astype(np.int32)), pa.py_buffer(data[index])])


def merged(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of half-open ranges; ranges that touch become one."""
    by = np.argsort(lo, kind="stable")
    lo, reach = lo[by], np.maximum.accumulate(hi[by])
    new = np.r_[True, lo[1:] > reach[:-1]] if len(lo) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    return lo[first], reach[np.r_[first[1:], len(lo)] - 1] if len(first) else reach


def pieces(batches: Iterator[pa.RecordBatch], text: str, overlap: int, most: int = CACHED) -> Iterator[tuple[pa.RecordBatch, int, np.ndarray, np.ndarray]]:
    """(rows, start, bytes, offsets): about `most` bytes of whole texts from their start 0; of a longer text, one row alone,
    pieces from several starts, each with the first `overlap` bytes of the next one."""
    for batch in batches:
        data, off = text_bytes(batch.column(batch.schema.get_field_index(text)))
        for i, j in row_slices(off, most):
            lo, hi = int(off[i]), int(off[j])
            for start in range(0, max(1, hi - lo - overlap), most) if j - i == 1 else (0,):
                part = data[lo + start : min(hi, lo + start + most + overlap)] if j - i == 1 else data[lo:hi]
                yield batch.slice(i, j - i), start, part, np.array([0, len(part)]) if j - i == 1 else off[i : j + 1] - off[i]


class CollectionTransform:
    """The collection Burrows-Wheeler transform of m strings and its common prefixes, one column of symbols after another.

    Places are those of all suffixes so far in their order; the m empty suffixes come first, by string. The transform at a place is the symbol
    before that suffix, NONE while that is not inserted; the prefix at a place is the length that it has in common with the
    place before. `last` is the place of each string's latest suffix.
    """

    def __init__(self, m: int, piece: int = 1 << 20):
        self.m = self.size = m
        self.piece = min(piece, 1 << 23)  # a place takes 23 bits of a key
        self.last = np.arange(m)
        self.order = np.arange(0)  # the strings that have symbols, by place of their latest suffix
        self.transform, self.common = (self._file(np.full(m, x, np.uint8)) for x in (NONE, 0))
        self.spare = self._file(), self._file()  # each round writes over what the round before the last one wrote, which is no longer

    @staticmethod
    def _file(content: np.ndarray | None = None) -> BinaryIO:
        f = tempfile.TemporaryFile()
        if content is not None:
            f.write(content.tobytes())
        return f

    def insert(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Insert the symbol of each string (NONE: it has none in this round; a string's rounds follow each other) -> (string, place, common prefix with the suffix
        before and with the one behind) of the new suffixes, by place."""
        active = symbols != NONE
        begun = np.zeros(self.m, bool)
        begun[self.order] = True
        owner = np.r_[np.flatnonzero(active & ~begun), self.order[active[self.order]]]  # empty suffixes come first
        at, symbol = self.last[owner], symbols[owner]
        found = self._ranks(at, symbol, owner)
        symbol, rank, common, string = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 4
        starts = self.m + np.cumsum(self.total) - self.total
        place = starts[symbol] + rank
        if len(found) > 1:  # one piece is in order already
            by = np.argsort(place)
            place, common, string = place[by], common[by], string[by]
        common = common.astype(np.uint8)
        new = string >= 0
        self._rewrite(at, symbols[owner], place[new], place, common)
        self.order = string[new]
        self.last[self.order] = place[new]
        self.size += int(new.sum())
        behind = np.where(np.diff(place, append=-1) == 1, np.append(common[1:], np.uint8(0)), 0)
        return string[new], place[new], common[new], behind[new]

    def _ranks(self, at: np.ndarray, symbol: np.ndarray, owner: np.ndarray) -> list[tuple]:
        """One pass over the files: for each new suffix, and for each old one that follows a new one directly, its first symbol,
        how many suffixes with that symbol stand before it, its common prefix with the suffix before, and its string (-1: old)."""
        self.total = np.zeros(256, np.int64)  # suffixes of each first symbol up to here
        least = np.full(256, 255, np.int64)  # of the common prefixes behind the last place of each symbol
        fresh = np.zeros(256, bool)  # whether that place is one of those filled now
        found = []
        self.transform.seek(0), self.common.seek(0)
        for x in range(0, self.size, self.piece):
            n = min(self.piece, self.size - x)
            b, c = (np.frombuffer(f.read(n), np.uint8) for f in (self.transform, self.common))
            i, j = np.searchsorted(at, (x, x + n))
            b = b.copy()
            b[at[i:j] - x] = symbol[i:j]
            key = b.astype(np.uint32) << np.uint32(24) | np.arange(0, 2 * n, 2, dtype=np.uint32)  # symbol, place, whether it is filled now
            key[at[i:j] - x] |= np.uint32(1)
            key.sort()
            begin = np.searchsorted(key, np.arange(256, dtype=np.uint32) << np.uint32(24))
            ends = np.append(begin[1:], begin[NONE])
            count = ends - begin
            key = key[: ends[NONE]]
            here = np.flatnonzero(count)
            first, end = begin[here], ends[here]
            new = (key & np.uint32(1)).astype(bool)
            wanted = new.copy()
            wanted[1:] |= new[:-1]
            wanted[first] = new[first] | fresh[here]
            k = np.flatnonzero(wanted)
            if len(k):
                s = (key[k] >> np.uint32(24)).astype(np.int64)
                low = np.append(c, np.uint8(255))
                head = np.zeros(len(key), bool)
                head[first] = True
                head = head[k]
                y = self._places(key[k])
                span = np.stack((np.where(head, 0, self._places(key[k - 1]) + 1), y + 1), axis=1).ravel()
                value = np.minimum.reduceat(low, span)[::2].astype(np.int64)
                value = np.where(head, np.where(self.total[s] > 0, np.minimum(value, least[s]), -1), value) + 1
                string = np.full(len(k), -1)
                string[new[k]] = owner[i + np.searchsorted(at[i:j], x + y[new[k]])]
                found.append((s, self.total[s] + k - begin[s], value, string))
            self.total += count
            if x + n == self.size:
                break
            after = np.append(np.minimum.accumulate(c[::-1])[::-1], np.uint8(255)).astype(np.int64)
            least = np.minimum(least, after[0])
            least[here] = after[self._places(key[end - 1]) + 1]
            fresh[here] = new[end - 1]
        return found

    @staticmethod
    def _places(key: np.ndarray) -> np.ndarray:
        return (key >> np.uint32(1) & np.uint32((1 << 23) - 1)).astype(np.int64)

    def _rewrite(self, at: np.ndarray, symbol: np.ndarray, new: np.ndarray, place: np.ndarray, common: np.ndarray) -> None:
        """The second pass: the files with the symbols filled in, the new suffixes (at `new`) and the common prefixes of `place`."""
        transform, prefixes = self.spare
        for f in (self.transform, self.common, *self.spare):
            f.seek(0)
        read = 0
        for x in range(0, self.size + len(new), self.piece):
            n = min(self.piece, self.size + len(new) - x)
            i, j = np.searchsorted(new, (x, x + n))
            old = np.ones(n, bool)
            old[new[i:j] - x] = False
            take = n - (j - i)
            b = np.frombuffer(self.transform.read(take), np.uint8).copy()
            p, q = np.searchsorted(at, (read, read + take))
            b[at[p:q] - read] = symbol[p:q]
            read += take
            out = np.full(n, NONE, np.uint8)
            out[old] = b
            transform.write(out.tobytes())
            out[old] = np.frombuffer(self.common.read(take), np.uint8)
            i, j = np.searchsorted(place, (x, x + n))
            out[place[i:j] - x] = common[i:j]
            prefixes.write(out.tobytes())
        self.spare = self.transform, self.common
        self.transform, self.common = transform, prefixes

    def close(self) -> None:
        for f in (self.transform, self.common, *self.spare):
            f.close()


def mark_collection(parts: pa.Array, lo_col: np.ndarray, rank: np.ndarray, width: int) -> np.ndarray:
    """marks[i, s]: the string from column s of segment i equals one of a segment of smaller rank.

    parts: bytes of the segments; lo_col: the column of each one's first byte. A segment whose latest suffix has too little in common with
    both neighbours to grow to a string of that width leaves.
    """
    m, columns, starts = len(parts), 2 * width - KEY, width - KEY + 1
    _, o, d = parts.buffers()
    off = np.frombuffer(o, np.int32)[parts.offset : parts.offset + m + 1].astype(np.int64)
    raw = np.frombuffer(d, np.uint8)
    size = np.diff(off)
    marks = np.zeros((m, starts), bool)
    index, open_ = CollectionTransform(m), np.ones(m, bool)
    for column in range(columns - 1, -1, -1):
        at = column - lo_col
        has = open_ & (at >= 0) & (at < size)
        if not has.any():
            continue
        string, place, common, behind = index.insert(np.where(has, raw[np.where(has, off[:-1] + at, 0)], NONE).astype(np.uint8))
        if column < width:
            open_[string[np.maximum(common, behind) < width - column]] = False
        if column < starts:
            equal = (common >= width) & np.r_[False, np.diff(place) == 1]
            first = np.flatnonzero(~equal)
            least = np.minimum.reduceat(rank[string], first)
            marks[string, column] = rank[string] > np.repeat(least, np.diff(np.r_[first, len(string)]))
    index.close()
    return marks


def repeat_filter(found: DataFrame) -> tuple[np.ndarray, int, int]:
    """Bits set for the hashes that occur more than once; sixteen bits a hash, at most 2^30. Their number, and that of the segments that have them."""
    repeated = Table(found.groupBy("h").agg(F.sum("n").alias("n")).filter("n > 1"), "repeated")
    hashes, segments = repeated.df.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    bits = min(30, max(20, (16 * hashes).bit_length()))
    slot = F.shiftrightunsigned("h", 64 - bits)
    words = repeated.df.groupBy(F.shiftright(slot, 5).cast("int").alias("word")).agg(F.expr(f"bit_or(shiftleft(1L, cast(shiftrightunsigned(h, {64 - bits}) & 31 as int)))").alias("set")).toArrow()
    out = np.zeros(1 << (bits - 5), np.uint32)
    out[words["word"].to_numpy()] = words["set"].to_numpy().astype(np.uint32)
    repeated.drop()
    return out, bits, segments


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 100, collection: int = 8_192, together: int = 16 << 20, bucket_rows: int = 50_000) -> DataFrame:
    """(doc_id, tag, spans): merged byte ranges to remove of each document that has any; tag is the text's XXH64.

    collection: segments indexed at once, unless a single anchor has more; together: bytes of segments among which a map
    task looks for equal ones; bucket_rows: segments of a bucket before equal ones are left out, by which the number of buckets grows.
    """
    if not KEY <= width <= 141:
        raise ValueError(f"width must be {KEY} to 141")
    docs = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(body(text_col)).alias("tag"), body(text_col).alias("text"))

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def counted(held: list[np.ndarray]) -> pa.RecordBatch:
            h, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int32))], names=["h", "n"])

        held: list[np.ndarray] = []
        for _, _, data, off in pieces(batches, "text", width - 1):
            held.append(anchor_runs(data, off, width)[0])
            if sum(map(len, held)) > 1 << 19:
                yield counted(held)
                held = []
        if held:
            yield counted(held)

    bitmap, bits, expected = repeat_filter(in_arrow(docs.select("text"), keys, "h long, n int"))
    settle(docs.sparkSession, executors=True)  # the heaps that the filter's job filled shrink before Python workers hold segments
    sent = docs.sparkSession.sparkContext.broadcast((bitmap, bits))
    id_field = T.StructField("doc_id", docs.schema["doc_id"].dataType)
    segment = T.StructType([T.StructField("h", T.LongType()), id_field, T.StructField("tag", T.LongType()), T.StructField("place", T.LongType()), T.StructField("part", T.BinaryType())])
    segment_arrow = to_arrow_schema(segment)
    buckets = max(4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-expected // bucket_rows))

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        """Runs that pass the filter, piece by piece: hash, row, (id, tag) of the piece's rows, start and anchor in the text, bytes."""
        bitmap, bits = sent.value
        for rows, start, data, off in pieces(batches, "text", width - 1):
            h, anchor, lo, hi = anchor_runs(data, off, width)
            slot = (h >> np.uint64(64 - bits)).astype(np.int64)
            keep = bitmap[slot >> 5] >> (slot & 31).astype(np.uint32) & 1 > 0
            h, anchor, lo, hi = h[keep], anchor[keep], lo[keep], hi[keep]
            of = np.searchsorted(off, lo, side="right") - 1
            yield h, of, [rows.column(0), rows.column(1)], lo - off[of] + start, anchor - lo, cut_bytes(data, lo, hi - lo + width)

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of equal segments the earliest, to be sent on; the others, with a null part, as ranges marked already."""
        held, size = [], 0
        for c in candidates(batches):
            held.append(c)
            size += c[5].nbytes
            if size > together:
                yield from packed(list(combined(held)))
                held, size = [], 0
        if held:
            yield from packed(list(combined(held)))

    def packed(rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows dealt to buckets by their hash, a bucket's rows as one compressed message."""
        if not rows:
            return
        t = pa.Table.from_batches(rows).combine_chunks().to_batches()[0]
        bucket = (t.column(0).to_numpy() % buckets).astype(np.int32)
        by = np.argsort(bucket, kind="stable")
        cuts = np.flatnonzero(np.r_[True, np.diff(bucket[by]) != 0])
        ends = np.r_[cuts[1:], len(by)]
        for i in range(0, len(cuts), 256):
            blobs = []
            for a, b in zip(cuts[i : i + 256], ends[i : i + 256]):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, segment_arrow, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                    w.write_batch(t.take(pa.array(by[a:b])))
                blobs.append(sink.getvalue().to_pybytes())
            yield pa.RecordBatch.from_arrays([pa.array(bucket[by][cuts[i : i + 256]]), pa.array(blobs, pa.binary())], names=["bucket", "blob"])

    def combined(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        base = np.r_[0, np.cumsum([len(x[2][0]) for x in held])]
        ids = pa.concat_arrays([x[2][0] for x in held]), pa.concat_arrays([x[2][1] for x in held])
        h, lo, rel = (np.concatenate([x[i] for x in held]) for i in (0, 3, 4))
        of = np.concatenate([x[1] + b for x, b in zip(held, base)])
        parts = pa.concat_arrays([x[5] for x in held])
        held.clear()
        if not len(h):
            return
        place = dense_ranks(*ids)[of] << 32 | lo  # order of segments; equal for the same place of a repeated row
        send, done = earliest(parts, place)
        take = lambda i: [c.take(pa.array(of[i])).cast(f.type) for c, f in zip(ids, list(segment_arrow)[1:3])]
        yield pa.RecordBatch.from_arrays([pa.array(h[send].view(np.int64)), *take(send), pa.array(lo[send] << 8 | rel[send]), parts.take(pa.array(send))], schema=segment_arrow)
        if len(done):
            size = lengths(parts)[done]
            by = np.argsort(of[done] << 32 | lo[done], kind="stable")
            done, size = done[by], size[by]
            a = of[done] << 32 | lo[done]  # texts are far apart, so ranges join within one only
            x, y = merged(a, a + size)
            which = done[np.searchsorted(a, x)]
            yield pa.RecordBatch.from_arrays([pa.array(h[which].view(np.int64)), *take(which), pa.array((x & 0xFFFFFFFF) << 32 | y - x), pa.nulls(len(x), pa.binary())], schema=segment_arrow)

    ranges = T.StructType([id_field, T.StructField("tag", T.LongType()), T.StructField("lo", T.LongType()), T.StructField("hi", T.LongType())])
    ranges_arrow = to_arrow_schema(ranges)

    def spans_of(doc_id: pa.Array, tag: pa.Array, which: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> pa.RecordBatch:
        take = pa.array(which)
        return pa.RecordBatch.from_arrays([doc_id.take(take).cast(ranges_arrow.field(0).type), tag.take(take), pa.array(lo), pa.array(hi)], schema=ranges_arrow)

    def whole_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        """All rows of one bucket at a time; messages come sorted by bucket."""
        now, held = None, []
        for b in batches:
            for bucket, blob in zip(b.column(0).to_pylist(), b.column(1)):
                if held and bucket != now:
                    yield pa.concat_tables(held)
                    held = []
                now = bucket
                held.append(pa.ipc.open_stream(blob.as_buffer()).read_all())
        if held:
            yield pa.concat_tables(held)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_buckets(batches):
            done = t.filter(pc.is_null(t["part"]))
            if done.num_rows:
                place = column(done, "place").to_numpy()
                yield spans_of(column(done, "doc_id"), column(done, "tag"), np.arange(len(place)), place >> 32, (place >> 32) + (place & 0xFFFFFFFF))
            del done
            t = t.filter(pc.is_valid(t["part"]))
            h = t["h"].to_numpy()
            t = t.take(pa.array(np.flatnonzero(repeats(h))))
            if t.num_rows:
                yield from marked(t)

    def marked(t: pa.Table) -> Iterator[pa.RecordBatch]:
        """Ranges of segments whose anchor hash is not alone in the bucket."""
        h, doc_id, tag, part = t["h"].to_numpy(), column(t, "doc_id"), column(t, "tag"), column(t, "part")
        place = column(t, "place").to_numpy()
        lo, rel, doc = place >> 8, place & 0xFF, dense_ranks(doc_id, tag) << 32
        keep, done = earliest(part, doc | lo)
        if len(done):
            yield spans_of(doc_id, tag, done, lo[done], lo[done] + lengths(part)[done])
        keep = keep[repeats(h[keep])]
        keep = keep[np.argsort(h[keep], kind="stable")]
        i, hs = 0, h[keep]
        while i < len(keep):  # whole groups of equal anchor hashes
            j = int(np.searchsorted(hs, hs[min(len(keep), i + collection) - 1], side="right"))
            some = keep[i:j]
            marks = mark_collection(part.take(pa.array(some)), width - KEY - rel[some], doc[some] | lo[some] + rel[some], width)
            edge = np.diff(np.pad(marks.astype(np.int8), ((0, 0), (1, 1))), axis=1)
            row, s = np.nonzero(edge == 1)
            _, e = np.nonzero(edge == -1)
            first = (lo + rel)[some[row]] - (width - KEY)
            yield spans_of(doc_id, tag, some[row], first + s, first + e - 1 + width)
            i = j

    sent_on = in_arrow(docs, segments, "bucket int, blob binary").repartition("bucket").sortWithinPartitions("bucket")
    listed = in_arrow(sent_on, mark, ranges).groupBy("doc_id", "tag").agg(F.collect_list("lo").alias("lo"), F.collect_list("hi").alias("hi"))

    def join_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            both = [merged(np.array(x), np.array(y)) for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([x for x, _ in both], pa.list_(pa.int64())), pa.array([y for _, y in both], pa.list_(pa.int64()))], names=["doc_id", "tag", "lo", "hi"])

    out = T.StructType([id_field, T.StructField("tag", T.LongType()), T.StructField("lo", T.ArrayType(T.LongType())), T.StructField("hi", T.ArrayType(T.LongType()))])
    spans = Table(in_arrow(listed, join_ranges, out), "spans").df
    sent.destroy()
    return spans


def repeats(h: np.ndarray) -> np.ndarray:
    """Whether each value occurs more than once."""
    _, where, n = np.unique(h, return_inverse=True, return_counts=True)
    return n[where] > 1


def lengths(parts: pa.Array) -> np.ndarray:
    return np.diff(np.frombuffer(parts.buffers()[1], np.int32)[parts.offset : parts.offset + len(parts) + 1]).astype(np.int64)


def earliest(parts: pa.Array, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of equal parts one with the least place, and all with another place than that."""
    code = parts.dictionary_encode().indices.to_numpy()
    by = np.lexsort((place, code))
    first = np.flatnonzero(np.r_[True, np.diff(code[by]) != 0])
    least = np.repeat(place[by][first], np.diff(np.r_[first, len(by)]))
    return by[first], by[place[by] != least]


def column(t: pa.Table, name: str) -> pa.Array:
    """A column as one array."""
    c = t[name].combine_chunks()
    return pa.concat_arrays(c.chunks) if isinstance(c, pa.ChunkedArray) else c


def dense_ranks(*columns: pa.Array) -> np.ndarray:
    """Ranks by the columns in turn, nulls first; equal rows get the same rank."""
    table = pa.table(list(columns), names=[str(i) for i in range(len(columns))])
    by = pc.sort_indices(table, sort_keys=[(n, "ascending") for n in table.column_names], null_placement="at_start").to_numpy()
    new = np.zeros(len(by), bool)
    for c in columns:
        s = c.take(pa.array(by))
        if len(s) > 1:
            differ = pc.fill_null(pc.not_equal(s.slice(1), s.slice(0, len(s) - 1)), False).to_numpy(zero_copy_only=False)
            null = pc.is_null(s).to_numpy(zero_copy_only=False)
            new[1:] |= differ | (null[1:] != null[:-1])
    rank = np.empty(len(by), np.int64)
    rank[by] = np.cumsum(new)
    return rank


def without(data: np.ndarray, off: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> pa.Array:
    """data[off[i]:off[i + 1]] of each i less the ranges data[lo:hi], which do not overlap, as a binary array. It is made from buffers, as
    pa.array never lets go of the memory beneath a memoryview, so that a worker would keep all texts that it has read."""
    if len(lo):
        edge = np.zeros(len(data) + 1, np.int8)
        edge[lo] += 1
        edge[hi] -= 1
        keep = np.cumsum(edge[:-1], dtype=np.int8) == 0
        data, off = data[keep], np.r_[0, np.cumsum(keep)][off]
    return pa.Array.from_buffers(pa.binary(), len(off) - 1, [None, pa.py_buffer(off.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 100) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, spans_lo, spans_hi (byte ranges removed), kept binary (the rest)."""
    spans = repeated_spans(docs, id_col, text_col, width)
    spans = small_side(spans, spans.count(), 300_000)
    left = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(body(text_col)).alias("tag"), body(text_col).alias("text"))
    joined = left.join(spans, left["doc_id"].eqNullSafe(spans["doc_id"]) & (left["tag"] == spans["tag"]), "left").select(left["doc_id"], "text", "lo", "hi")
    out = T.StructType([left.schema["doc_id"], T.StructField("n_bytes", T.LongType()), T.StructField("spans_lo", T.ArrayType(T.LongType())), T.StructField("spans_hi", T.ArrayType(T.LongType())), T.StructField("kept", T.BinaryType())])
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, off in blocks(batches, "text"):
            lo, hi = (pc.coalesce(rows.column(i), pa.scalar([], rows.column(i).type)) for i in (2, 3))
            text = off[pc.list_parent_indices(lo).to_numpy()]
            kept = without(data, off, text + pc.list_flatten(lo).to_numpy(), text + pc.list_flatten(hi).to_numpy())
            yield pa.RecordBatch.from_arrays([rows.column(0).cast(arrow.field(0).type), pa.array(np.diff(off)), lo, hi, kept], schema=arrow)

    return in_arrow(joined, run, out)
