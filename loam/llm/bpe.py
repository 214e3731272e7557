"""Byte-level BPE encoding and decoding with DuckDB recursive queries in each partition.

Texts are read in pieces of a few MB. A piece is cut into pre-tokens by the split pattern, all at once on its code
points, and its distinct pre-tokens go to an in-memory DuckDB: their bytes are token-position rows, an ordered aggregation makes a list of
tokens of each word, and a recursive query joins neighbouring tokens with the merge table and contracts each word's leftmost pair of least rank
until none is left. Decoding joins the ids with the vocabulary and aggregates the bytes in order.
A Python worker keeps what it has encoded over all partitions that it serves, which saves work but changes no result: beyond ``remember`` words
it forgets the half that was not met for longest, beyond MEAN bytes for each of these all of them.
A recursion step contracts one pair of a word, so a word of n bytes takes up to n steps over its tokens; pre-tokens of more than LONG bytes, as
in texts without blanks, are contracted in the same order with a heap instead.

The vocabulary file is read on the driver and sent to the executors: its size is fixed by the tokenizer.

Defined results: a null text counts as empty and has no ids; every other column is left alone; an empty table gives an
empty result.
"""

from __future__ import annotations

import base64
import heapq
import tempfile
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import blocks, body, in_arrow, row_slices

OTHER, LETTER, NUMBER, SPACE = range(4)
#: Bytes of the longest pre-token that goes to the recursive query.
LONG = 256
#: Bytes of the words that a worker keeps, for each word that it may keep.
MEAN = 64


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(t): int(r) for t, r in map(bytes.split, f)}


def code_point_kinds() -> np.ndarray:
    """OTHER, LETTER, NUMBER or SPACE of every code point, as the split pattern's classes have it."""
    kinds = np.zeros(0x110000, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for m in regex.finditer(pattern, every):
            a, b = ord(m[0][0]), ord(m[0][-1])
            if b - a == len(m[0]) - 1:
                kinds[a : b + 1] = kind
            else:
                kinds[[ord(c) for c in m[0]]] = kind
    return kinds


def byte_kinds(data: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """The kind of the character that each byte belongs to."""
    kind = kinds[:256].copy()
    kind[0x80:] = OTHER
    kind = kind[data]
    for lead, size, mask in ((0xC0, 2, 0x1F), (0xE0, 3, 0x0F), (0xF0, 4, 0x07)):
        at = np.flatnonzero((data >= lead) & (data < (0xE0, 0xF0, 0xF8)[size - 2]))
        if len(at):
            c = data[at].astype(np.int64) & mask
            for k in range(1, size):
                c = c << 6 | data[at + k] & 0x3F
            for k in range(size):
                kind[at + k] = kinds[c]
    return kind


def split_points(data: np.ndarray, off: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Byte offsets of all pre-tokens' starts, over texts that lie end to end; pre-tokens never cross texts.

    The rules of the pattern: runs of letters, of numbers and of other signs, each with one blank before it; a run of
    white space without the last character if more text follows; the contractions 's 't 're 've 'm 'll 'd.
    """
    n = len(data)
    kind = byte_kinds(data, kinds)
    first = np.zeros(n + 1, bool)  # a text starts here
    first[off[:-1]] = True
    first[n] = True
    run = np.ones(n, bool)  # a run of one kind starts here
    np.not_equal(kind[1:], kind[:-1], out=run[1:])
    run |= first[:n]
    start = run.copy()
    begins = np.flatnonzero(run)
    words = begins[(kind[begins] != SPACE) & ~first[begins]]
    last = words[kind[words - 1] == SPACE] - 1  # the last white space before a word: \s+(?!\S) leaves it ...
    for _ in range(3):
        last = np.where((data[last] & 0xC0) == 0x80, last - 1, last)
    start[last] = True
    blank = last[data[last] == 0x20]
    start[blank + 1] = False  # ... to the word if it is a blank
    # contractions: a lone apostrophe that starts a pre-token, then letters
    ap = begins[(data[begins] == 0x27) & start[begins] & (begins + 1 < n)]
    ap = ap[run[ap + 1] & (kind[ap + 1] == LETTER) & ~first[ap + 1]]
    for tail in (b"s", b"t", b"re", b"ve", b"m", b"ll", b"d"):
        hit = ap[ap + len(tail) < n]
        for k, ch in enumerate(tail, 1):
            hit = hit[(data[hit + k] == ch) & ~first[hit + k]]
        start[hit + 1] = False
        end = hit + 1 + len(tail)
        end = end[end < n]
        start[end[kind[end] == LETTER]] = True  # the rest of the run is a pre-token of its own
    return np.flatnonzero(start)


ENCODE = """
with recursive step(w, toks, live) as (
  select w, list(tok order by pos), true from fresh group by w
  union all
  (with pairs as (
     select s.w, min((m.rank::bigint << 32) | s.i) as cost
     from (select w, unnest(toks[: -2]) as tok, unnest(toks[2 :]) as right_tok, unnest(range(1, len(toks))) as i from step where live) s
     join merges m on m.pair = (s.tok::bigint << 32) | s.right_tok group by s.w),
   best as (select s.w, s.toks, p.cost, p.cost & 4294967295 as i from step s left join pairs p on p.w = s.w where s.live)
   select w, case when cost is null then toks else toks[: i - 1] || [(cost >> 32)::int] || toks[i + 2 :] end, cost is not null from best)
)
select w, toks as ids from step where not live order by w
"""

DECODE = "select t.w, from_hex(string_agg(v.hex, '' order by t.pos)) as bytes from coded t join vocab v on v.tok = t.tok group by t.w order by t.w"


class Coder:
    """Encodes and decodes distinct words in one DuckDB database; one for each Python worker and vocabulary."""

    def __init__(self, ranks: dict[bytes, int], memory: str = "200MB"):
        self.ranks = ranks
        self.pairs: dict[int, int] = {}
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": memory, "temp_directory": tempfile.gettempdir()})
        self.con.execute("set preserve_insertion_order = false")
        pair, rank = [], []
        for token, r in ranks.items():
            for i in range(1, len(token)):
                if (a := ranks.get(token[:i])) is not None and (b := ranks.get(token[i:])) is not None:
                    pair.append(a << 32 | b), rank.append(r)
        self._table("merges", pair=pa.array(pair, pa.int64()), rank=pa.array(rank, pa.int32()))
        self._table("vocab", tok=pa.array(ranks.values(), pa.int32()), hex=pa.array([t.hex() for t in ranks]))
        self.single = np.array([ranks[bytes([i])] for i in range(256)], np.int32)

    def _table(self, name: str, **columns: object) -> None:
        self.con.register("arrow_in", pa.table(columns))
        self.con.execute(f"create or replace temp table {name} as select * from arrow_in")
        self.con.unregister("arrow_in")

    def encode_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Distinct non-empty binary words -> (all their ids end to end, n + 1 offsets)."""
        n = len(words)
        _, offsets, data = words.buffers()
        off = np.frombuffer(offsets, np.int32)[words.offset : words.offset + n + 1].astype(np.int64)
        raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]]
        off = off - off[0]
        size = np.diff(off)
        whole = np.fromiter((self.ranks.get(w, -1) for w in words.to_pylist()), np.int32, n)  # a word that is a token is that token
        ids = [whole[whole >= 0]]
        owner = [np.flatnonzero(whole >= 0)]
        rest = whole < 0
        for w in np.flatnonzero(rest & (size > LONG)).tolist():
            ids.append(self.contracted(words[w].as_py()))
            owner.append(np.full(len(ids[-1]), w))
        rest &= size <= LONG
        if rest.any():
            of = np.repeat(np.arange(n, dtype=np.int32), size)
            pos = (np.arange(len(raw)) - np.repeat(off[:-1], size)).astype(np.int32)
            keep = rest[of]
            self._table("fresh", w=of[keep], pos=pos[keep], tok=self.single[raw[keep]])
            done = self.con.sql(ENCODE).to_arrow_table()
            lists = done["ids"].combine_chunks()
            lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
            ids.append(lists.flatten().to_numpy())
            owner.append(np.repeat(done["w"].to_numpy(), pc.list_value_length(lists).to_numpy()))
            self.con.execute("drop table fresh")
        ids, owner = np.concatenate(ids), np.concatenate(owner)
        by = np.argsort(owner, kind="stable")
        return ids[by].astype(np.int32), np.r_[0, np.cumsum(np.bincount(owner, minlength=n))]

    def contracted(self, word: bytes) -> np.ndarray:
        """Ids of a long word: its leftmost pair of least rank is contracted until none is left, by a heap of (rank, place)."""
        if not self.pairs:
            self.pairs = dict(self.con.sql("select pair, rank from merges").fetchall())
        n = len(word)
        tok, after, before = self.single[np.frombuffer(word, np.uint8)].tolist(), [*range(1, n + 1)], [*range(-1, n - 1)]
        rank = self.pairs.get
        heap = [(r, i) for i, (a, b) in enumerate(zip(tok, tok[1:])) if (r := rank(a << 32 | b)) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i] if tok[i] >= 0 else n
            if j >= n or rank(tok[i] << 32 | tok[j]) != r:
                continue  # one of the two is no more
            tok[i], tok[j], after[i] = r, -1, after[j]
            if after[j] < n:
                before[after[j]] = i
                if (x := rank(r << 32 | tok[after[j]])) is not None:
                    heapq.heappush(heap, (x, i))
            if before[i] >= 0 and (x := rank(tok[before[i]] << 32 | r)) is not None:
                heapq.heappush(heap, (x, before[i]))
        return np.array([t for t in tok if t >= 0], np.int32)

    def decode_words(self, ids: np.ndarray, off: np.ndarray) -> pa.Array:
        """Bytes of each range of ids, by ordered aggregation; every range is non-empty."""
        size = np.diff(off)
        self._table("coded", w=np.repeat(np.arange(len(size)), size), pos=np.arange(len(ids)), tok=ids)
        out = self.con.sql(DECODE).to_arrow_table()["bytes"].combine_chunks()
        return out.chunk(0) if isinstance(out, pa.ChunkedArray) else out


def gather(flat: np.ndarray, off: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranges number codes[0], codes[1], ... of flat end to end, and their offsets."""
    size = (off[1:] - off[:-1])[codes]
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    index = np.arange(total) + np.repeat(off[:-1][codes] - (ends - size), size)
    return flat[index], np.r_[0, ends]


class Cache:
    """The ids of the words met so far, and the bytes that these ids decode to; one for each Python worker and vocabulary."""

    def __init__(self, coder: Coder, remember: int):
        self.coder, self.remember = coder, remember
        self.clear()

    def clear(self) -> None:
        self.number: dict[bytes, int] = {}
        self.ids, self.ids_off = np.zeros(0, np.int32), np.zeros(1, np.int64)
        self.text, self.text_off = np.zeros(0, np.uint8), np.zeros(1, np.int64)
        self.met, self.time = np.zeros(0, np.int32), 0  # when each word was met last

    def forget(self) -> None:
        """Keeps the later half of the words; none if they are long or few may be kept."""
        keep = np.sort(np.argsort(-self.met, kind="stable")[: self.remember // 2])  # of words met at the same time, those known for longer
        if self.remember < 2 or len(self.text) > MEAN * self.remember:
            self.clear()
            return
        words = list(self.number)
        self.number = {words[i]: n for n, i in enumerate(keep.tolist())}
        self.ids, self.ids_off = gather(self.ids, self.ids_off, keep)
        self.text, self.text_off = gather(self.text, self.text_off, keep)
        self.met = self.met[keep]

    def look_up(self, words: pa.Array) -> np.ndarray:
        """Numbers of distinct words; the new ones are encoded, and their ids decoded, by one query each."""
        if len(self.number) > self.remember or len(self.text) > MEAN * self.remember:
            self.forget()
        keys = words.to_pylist()
        at = np.fromiter((self.number.get(w, -1) for w in keys), np.int64, len(keys))
        fresh = np.flatnonzero(at < 0)
        if len(fresh):
            ids, off = self.coder.encode_words(words.take(pa.array(fresh)))
            text, text_off = binary_parts(self.coder.decode_words(ids, off))
            at[fresh] = len(self.number) + np.arange(len(fresh))
            self.number.update((keys[i], n) for n, i in enumerate(fresh.tolist(), len(self.number)))
            self.ids, self.ids_off = np.r_[self.ids, ids], np.r_[self.ids_off, self.ids_off[-1] + off[1:]]
            self.text, self.text_off = np.r_[self.text, text], np.r_[self.text_off, self.text_off[-1] + text_off[1:]]
            self.met = np.r_[self.met, np.zeros(len(fresh), np.int32)]
        self.time += 1
        self.met[at] = self.time
        return at


def binary_parts(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    _, offsets, data = col.buffers()
    off = np.frombuffer(offsets, np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[off[0] : off[-1]], off - off[0]


def binary_array(flat: np.ndarray, off: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(off) - 1, [None, pa.py_buffer(off.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(flat))])


_coders: dict[int, Coder] = {}
_caches: dict[int, Cache] = {}
_kinds: list[np.ndarray] = []


def worker_coder(key: int, ranks: dict[bytes, int]) -> Coder:
    """Python workers serve many partitions; the vocabulary's tables are kept."""
    if key not in _coders:
        _coders.clear()
        _caches.clear()
        _coders[key] = Coder(ranks)
    return _coders[key]


def worker_cache(key: int, ranks: dict[bytes, int], remember: int) -> Cache:
    """The words that the worker knows from its partitions so far."""
    coder = worker_coder(key, ranks)
    if remember not in _caches:
        _caches.clear()
        _caches[remember] = Cache(coder, remember)
    return _caches[remember]


def kinds() -> np.ndarray:
    if not _kinds:
        _kinds.append(code_point_kinds())
    return _kinds[0]


def encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False, remember: int = 400_000) -> DataFrame:
    """doc_id, ids array<int> for every row, and with ``decoded`` the bytes that the ids decode to.

    vocabulary: a rank file of base64 tokens and ranks, read on the driver.
    """
    ranks = read_ranks(vocabulary)
    sent, key = docs.sparkSession.sparkContext.broadcast(ranks), hash((vocabulary, len(ranks)))
    out = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("ids", T.ArrayType(T.IntegerType(), False))])
    if decoded:
        out.add("decoded", T.BinaryType())
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = worker_cache(key, sent.value, remember)
        for rows, data, off in blocks(batches, "text", 1 << 20):
            starts = split_points(data, off, kinds())
            coded = binary_array(data, np.r_[starts, len(data)]).dictionary_encode()
            number = cache.look_up(coded.dictionary)[coded.indices.to_numpy()]
            word = np.searchsorted(starts, off)  # the first pre-token of each text
            ids, at = gather(cache.ids, cache.ids_off, number)
            columns = [rows.column(0).cast(arrow.field(0).type), pa.ListArray.from_arrays(pa.array(at[word], pa.int32()), pa.array(ids), type=arrow.field(1).type)]
            if decoded:
                text, at = gather(cache.text, cache.text_off, number)
                columns.append(binary_array(text, at[word]))
            yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return in_arrow(docs.select(F.col(id_col).alias("doc_id"), body(text_col).alias("text")), run, out)


def decode(coded: DataFrame, vocabulary: str, ids_col: str = "ids", keep: tuple[str, ...] = ("doc_id",), most: int = 1 << 20) -> DataFrame:
    """The kept columns, ids and decoded binary. Null ids count as none; an id outside the vocabulary is an error.

    Texts are cut before tokens that begin with white space, so that equal runs are aggregated once.
    """
    ranks = read_ranks(vocabulary)
    sent, key = coded.sparkSession.sparkContext.broadcast(ranks), hash((vocabulary, len(ranks)))
    source = coded.select(*keep, F.coalesce(F.col(ids_col).cast("array<int>"), F.array().cast("array<int>")).alias("ids"))
    out = T.StructType([*source.schema.fields, T.StructField("decoded", T.BinaryType())])
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = worker_coder(key, sent.value)
        opens = np.zeros(max(coder.ranks.values()) + 1, bool)
        opens[[r for t, r in coder.ranks.items() if t[:1].isspace()]] = True
        for batch in batches:
            lists = batch.column(batch.num_columns - 1)
            off = np.r_[0, np.cumsum(pc.list_value_length(lists).to_numpy())].astype(np.int64)
            for i, j in row_slices(off, most):
                part = batch.slice(i, j - i)
                ids, ends = part.column(part.num_columns - 1).flatten().to_numpy(), off[i : j + 1] - off[i]
                if len(ids) and (ids.min() < 0 or ids.max() >= len(opens)):
                    raise ValueError("an id is outside the vocabulary")
                cut = opens[ids]
                cut[ends[:-1][np.diff(ends) > 0]] = True
                cuts = np.r_[np.flatnonzero(cut), len(ids)]
                runs = binary_array(ids.view(np.uint8), cuts * 4).dictionary_encode()
                text, at = np.zeros(0, np.uint8), np.zeros(1, np.int64)
                if len(ids):
                    flat, run_off = binary_parts(runs.dictionary)
                    text, at = gather(*binary_parts(coder.decode_words(flat.view(np.int32), run_off // 4)), runs.indices.to_numpy())
                yield pa.RecordBatch.from_arrays([*(c.cast(f.type) for c, f in zip(part.columns, arrow)), binary_array(text, at[np.searchsorted(cuts, ends)])], schema=arrow)

    return in_arrow(source, run, out)
