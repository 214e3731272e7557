"""Line dedup over the suffix array of line-id sequences, by distributed prefix doubling.

A suffix is a text from one of its lines on. A round names every suffix by its first h lines: its name is the place that the first of all
suffixes with these lines has in the suffix array so far, so equal names mean equal prefixes and names follow the prefixes' order.
The next round sorts the pairs (name here, name h lines on) of all suffixes that still share a name, and their places in that sort are
their new names. A suffix is final when its name is its own or when its text ends within the prefix; rounds go on until all are. (One round
may reach fewer lines, so that the least run length is among them.) The sorts are range partitions over pair and place
in the corpus, so a hot line or pair is spread over tasks; counts carry over from one partition to the next by one row a partition. A
document's names lie in one row, so that looking ahead needs no join.

The suffixes of one name of h lines are an interval of the array whose longest common prefix is at least that. Sorted by their place in the
corpus, the first one stays and each other is a window of h lines that also starts earlier; windows of the least run length and more join to the
maximal repeated runs, which are deleted. A long line, which may hold a whole passage, can count as a run by itself.

Texts that are equal as a whole enter the array once; the later ones are repeated runs from end to end.

Defined results: a null text counts as empty and has one empty line; ids order the documents (null first), rows with equal
ids by a hash of their text; rows that repeat both are one document and get the same result; an empty table gives an
empty result; further columns stay as they are, whatever their names, but for `line_dedup`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import Table, body, in_arrow, settle, small_side
from .suffix_dedup import merged

#: A suffix's place in the corpus.
WHERE = ("doc_id", "tag", "pos")


def changes(cols: list[pa.Array]) -> np.ndarray:
    """For each row but the first whether any column differs from the row before; nulls are equal."""
    out = np.zeros(len(cols[0]) - 1, bool)
    for c in cols:
        a, b = c.slice(1), c.slice(0, len(c) - 1)
        same = pc.or_(pc.fill_null(pc.equal(a, b), False), pc.and_(pc.is_null(a), pc.is_null(b)))
        out |= ~same.to_numpy(zero_copy_only=False)
    return out


def sorted_groups(rows: DataFrame) -> tuple[DataFrame, Table]:
    """rows(a, b, doc_id, tag, pos, ...), a and b long -> the same without repeated rows, and their places in the order of all these columns:
    row, start_a and start_b of the first row with the same a, and the same a and b, and n_b, the number of the latter."""
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    by = ["a", "b", *WHERE]
    ordered = rows.repartitionByRange(parts, *by).sortWithinPartitions(*by)
    local = ("part", "at", "at_a", "at_b", "size_b")
    out = T.StructType([*ordered.schema.fields, *(T.StructField(c, T.LongType()) for c in local)])
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Places within the partition. Rows of a group that may go on are held until it ends."""
        part, read, at_a = TaskContext.get().partitionId(), 0, 0
        held: pa.Table | None = None
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            whole, held = cut_group(t if held is None else pa.concat_tables([held, t]))
            if whole is not None:
                done, at_a = numbered(whole, part, read, at_a)
                yield done
                read += done.num_rows
                if held["a"][0].as_py() != whole["a"][-1].as_py():
                    at_a = read
        if held is not None:
            yield numbered(held, part, read, at_a)[0]

    def cut_group(t: pa.Table) -> tuple[pa.Table | None, pa.Table]:
        """Whole groups of (a, b), and the last group."""
        a, b = t["a"].to_numpy(), t["b"].to_numpy()
        cut = int(np.searchsorted(a, a[-1]))
        cut += int(np.searchsorted(b[cut:], b[-1]))
        return (t.slice(0, cut) if cut else None), t.slice(cut)

    def numbered(t: pa.Table, part: int, read: int, at_a: int) -> tuple[pa.RecordBatch, int]:
        """Whole groups without repeated rows, behind `read` others; at_a: where the first a began. Also where the last one did."""
        r = t.combine_chunks().to_batches()[0]
        col = lambda c: r.column(r.schema.get_field_index(c))
        new = np.r_[True, changes([col(c) for c in by])]
        r = r.filter(pa.array(new))
        a, b = col("a").to_numpy(), col("b").to_numpy()
        i = np.arange(len(a))
        first_a = np.r_[True, np.diff(a) != 0]
        first_b = first_a | np.r_[True, np.diff(b) != 0]
        starts = np.flatnonzero(first_b)
        start_a = read + np.maximum.accumulate(np.where(first_a, i, 0))
        start_a[: np.flatnonzero(first_a)[1] if first_a.sum() > 1 else len(a)] = at_a
        size = np.diff(np.r_[starts, len(a)])
        facts = (np.full(len(a), part), read + i, start_a, read + np.repeat(starts, size), np.repeat(size, size))
        return pa.RecordBatch.from_arrays([*(c.cast(f.type) for c, f in zip(r.columns, arrow)), *(pa.array(x, pa.int64()) for x in facts)], schema=arrow), int(start_a[-1])

    table = Table(in_arrow(ordered, run, out), "sorted")
    ends = table.df.groupBy("part").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("a", "b", "at_b", "size_b")).alias("lo"), F.max(F.struct("a", "b", "at_a", "at_b", "size_b")).alias("hi")
    )  # one row for each partition
    places = joined_ends(sorted(ends.collect()))
    places = spark.createDataFrame(places, "part long, before long, first_a long, first_b long, first_n long, last_b long, last_n long")
    p = table.df.join(F.broadcast(places), "part")
    here = lambda c: F.col("before") + F.col(c)
    head, tail = F.col("at_b") == 0, F.col("at_b") == F.col("last_b")
    start_b = F.when(head, F.col("first_b")).otherwise(here("at_b"))
    n_b = F.when(head, F.col("first_n")).when(tail, F.col("last_n")).otherwise(F.col("size_b"))
    start_a = F.when(F.col("at_a") == 0, F.col("first_a")).otherwise(here("at_a"))
    return p.select(*rows.columns, here("at").alias("row"), start_a.alias("start_a"), start_b.alias("start_b"), n_b.alias("n_b")), table


def joined_ends(ends: list) -> list[tuple]:
    """Partitions' first and last groups -> (part, rows before, start of the first a, of its b, size of that, local start of the last b, its size), each
    group with what it has in the partitions around."""
    before, n = [], 0
    for e in ends:
        before.append(n)
        n += e["n"]
    whole: dict[tuple, int] = {}
    for e in ends:
        whole[e["lo"]["a"], e["lo"]["b"]] = whole.get((e["lo"]["a"], e["lo"]["b"]), 0) + e["lo"]["size_b"]
        if e["hi"]["at_b"]:
            whole[e["hi"]["a"], e["hi"]["b"]] = whole.get((e["hi"]["a"], e["hi"]["b"]), 0) + e["hi"]["size_b"]
    out, a, b = [], (None, 0), (None, 0)  # the last value so far and the place where it began
    for e, at in zip(ends, before):
        first_a, first_b = e["lo"]["a"], (e["lo"]["a"], e["lo"]["b"])
        a = a if a[0] == first_a else (first_a, at)
        b = b if b[0] == first_b else (first_b, at)
        last = e["hi"]["a"], e["hi"]["b"]
        out.append((e["part"], at, a[1], b[1], whole[first_b], e["hi"]["at_b"], whole[last]))
        if e["hi"]["at_a"]:
            a = (e["hi"]["a"], at + e["hi"]["at_a"])
        if e["hi"]["at_b"]:
            b = (last, at + e["hi"]["at_b"])
    return out


def same_document(a: DataFrame, b: DataFrame) -> DataFrame:
    """Inner join on the document; null ids are equal."""
    return a.join(b, a["doc_id"].eqNullSafe(b["doc_id"]) & (a["tag"] == b["tag"])).drop(b["doc_id"]).drop(b["tag"])


def per_document(rows: DataFrame) -> DataFrame:
    """rows(doc_id, tag, pos, name, open) -> (doc_id, tag, pos, name, open) with arrays in the order of the lines."""
    listed = F.array_sort(F.collect_list(F.struct("pos", "name", "open")))
    return rows.groupBy("doc_id", "tag").agg(listed.alias("l")).select("doc_id", "tag", "l.pos", "l.name", "l.open")


def renamed(state: DataFrame, fresh: DataFrame) -> DataFrame:
    """state(doc_id, tag, name, open) with the fresh(doc_id, tag, pos, name, open) of its documents; those without any go."""
    out = state.schema
    both = same_document(state, per_document(fresh).toDF("doc_id", "tag", "pos", "new_name", "new_open")).select("doc_id", "tag", "name", "open", "pos", "new_name", "new_open")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            (name, name_off), (open_, _), (pos, at), (new_name, _), (new_open, _) = (flat(b.column(i)) for i in range(2, 7))
            name, open_ = name.copy(), np.zeros(len(name), bool)
            place = pos + np.repeat(name_off[:-1], np.diff(at))
            name[place], open_[place] = new_name, new_open
            lists = [pa.ListArray.from_arrays(pa.array(name_off, pa.int32()), pa.array(x)) for x in (name, open_)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *lists], names=["doc_id", "tag", "name", "open"])

    return in_arrow(both, run, out)


def flat(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Values end to end and their offsets."""
    return lists.flatten().to_numpy(zero_copy_only=False), np.r_[0, np.cumsum(pc.list_value_length(lists).to_numpy())].astype(np.int64)


def pairs(state: DataFrame, ahead: int) -> DataFrame:
    """state -> (a, b, doc_id, tag, pos, left) of open suffixes: a its name, b the name of the suffix `ahead` lines on, -1 behind the text."""
    out = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType()), state.schema["doc_id"], *(T.StructField(c, T.LongType()) for c in ("tag", "pos", "left"))])
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            (name, off), (open_, _) = flat(b.column(2)), flat(b.column(3))
            of = np.repeat(np.arange(b.num_rows), np.diff(off))
            i = np.flatnonzero(open_)
            end = off[1:][of[i]]
            second = np.where(i + ahead < end, name[np.minimum(i + ahead, len(name) - 1)], -1)
            take = pa.array(of[i])
            yield pa.RecordBatch.from_arrays([pa.array(name[i]), pa.array(second), b.column(0).take(take).cast(arrow.field(2).type), b.column(1).take(take), pa.array(i - off[of[i]]), pa.array(end - i)], schema=arrow)

    return in_arrow(state.select("doc_id", "tag", "name", "open"), run, out)


def repeated_windows(lines: DataFrame, least: int) -> tuple[DataFrame | None, list[Table]]:
    """lines(a, b, doc_id, tag, pos, left, long), a and b the line's hashes -> (doc_id, tag, pos, n) of windows of n lines that also start earlier.

    n is `least` or more, and 1 for lines marked `long`. Builds the whole array; see the module's description.
    """
    named, first = sorted_groups(lines)
    later = [named.filter((F.col("row") > F.col("start_b")) & (F.col("long") | F.lit(least == 1))).select(*WHERE, F.lit(1).alias("n"))]
    kept = [first]
    rows = named.select("doc_id", "tag", "pos", F.col("start_b").alias("name"), (F.col("n_b") > 1).alias("open"))
    made = Table(per_document(rows).filter(F.exists("open", lambda x: x)).drop("pos"), "names")
    h = 1
    while not made.df.isEmpty():
        step = least - h if h < least < 2 * h else h
        named, table = sorted_groups(pairs(made.df, step))
        kept.append(table)
        h += step
        if h >= least:
            later.append(named.filter((F.col("row") > F.col("start_b")) & (F.col("left") >= h)).select(*WHERE, F.lit(h).alias("n")))
        name = F.col("a") + F.col("start_b") - F.col("start_a")  # a was the place of the first of all with that name
        fresh = named.select("doc_id", "tag", "pos", name.alias("name"), ((F.col("n_b") > 1) & (F.col("b") >= 0)).alias("open"))
        new = Table(renamed(made.df, fresh).filter(F.exists("open", lambda x: x)), "names")
        made.drop()
        made = new
        settle(lines.sparkSession)
    made.drop()
    out = later[0]
    for x in later[1:]:
        out = out.unionByName(x)
    return out, kept


def text_hashes(text: Column) -> list[Column]:
    """Two independent 64-bit hashes."""
    return [F.xxhash64(text), F.xxhash64(F.lit(1), text)]


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_lines: int = 2, long_words: int | None = None) -> DataFrame:
    """All columns of docs with the text shortened, and line_dedup: struct(n_lines, n_removed, n_runs).

    min_lines: least number of lines of a repeated run. long_words: a repeated line of so many words (parted by ASCII
    white space) or more is a run by itself.
    """
    (tag, tag2), split = text_hashes(body(text_col)), F.split(body(text_col), "\n", -1)
    own = docs.select(F.col(id_col).alias("doc_id"), tag.alias("tag"), tag2.alias("tag2"), body(text_col).alias("text"))
    ids = own.filter(F.size(F.split("text", "\n", -1)) >= min_lines).groupBy("tag", "tag2").agg(F.min(F.struct("doc_id")).alias("first"), F.max(F.struct("doc_id")).alias("last"))
    copies = Table(ids.filter("not (first <=> last)").select(F.col("tag").alias("_c1"), F.col("tag2").alias("_c2"), F.col("first.doc_id").alias("_first"), F.lit(True).alias("_copied")), "copies").df
    copies = small_side(copies, copies.count(), 300_000)
    single = own.join(copies, (F.col("tag") == F.col("_c1")) & (F.col("tag2") == F.col("_c2")), "left").filter(F.col("_copied").isNull() | F.col("doc_id").eqNullSafe(F.col("_first")))
    lines = single.select("doc_id", "tag", F.split("text", "\n", -1).alias("lines"))
    lines = lines.select("doc_id", "tag", F.size("lines").alias("total"), F.posexplode("lines").alias("pos", "line"))
    long = F.lit(False) if long_words is None else (F.length("line") >= 2 * long_words - 1) & (F.size(F.split(F.regexp_replace("line", r"^\s+|\s+$", ""), r"\s+")) >= long_words)
    a, b = text_hashes(F.col("line"))
    lines = Table(lines.select(a.alias("a"), b.alias("b"), "doc_id", "tag", F.col("pos").cast("long").alias("pos"), long.alias("long")), "lines")
    windows, made = repeated_windows(lines.df, min_lines)
    listed = windows.groupBy("doc_id", "tag").agg(F.collect_list(F.struct("pos", "n")).alias("runs"))
    out = T.StructType([*listed.schema.fields[:2], T.StructField("lo", T.ArrayType(T.IntegerType())), T.StructField("hi", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(2)
            pos, n = lists.values.field(0).to_numpy(), lists.values.field(1).to_numpy()
            off = lists.offsets.to_numpy()
            runs = [merged(pos[i:j], pos[i:j] + n[i:j]) for i, j in zip(off[:-1], off[1:])]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array([r[i].astype(np.int32) for r in runs], pa.list_(pa.int32())) for i in (0, 1))], names=["doc_id", "tag", "lo", "hi"])

    runs = Table(in_arrow(listed, run, out), "runs").df
    for t in (lines, *made):
        t.drop()
    runs = small_side(runs.toDF("_id", "_tag", "_lo", "_hi"), runs.count(), 300_000)
    # docs packed, so that no name of theirs meets one of ours
    held = docs.select(F.struct(*docs.columns).alias("_row"), tag.alias("_hash"), tag2.alias("_hash2"))
    own = lambda c: F.col("_row").getField(c)
    joined = held.join(copies, (F.col("_hash") == F.col("_c1")) & (F.col("_hash2") == F.col("_c2")), "left")
    joined = joined.join(runs, own(id_col).eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_tag")), "left")
    split = F.split(F.coalesce(own(text_col), F.lit("")), "\n", -1)
    copy = F.col("_copied") & ~own(id_col).eqNullSafe(F.col("_first"))  # a later copy is one run from end to end
    ends = lambda c, at: F.when(copy, F.array(at)).otherwise(F.col(c))
    joined = joined.withColumns({"_lo": ends("_lo", F.lit(0)), "_hi": ends("_hi", F.size(split))})
    # the lines between the runs: from each run's end to the next one's start
    n = F.size(split)
    starts, ends = F.concat(F.array(F.lit(0)), F.col("_hi")), F.concat(F.col("_lo"), F.array(n))
    kept = F.flatten(F.transform(F.arrays_zip(starts.alias("s"), ends.alias("e")), lambda r: F.slice(split, r["s"] + 1, r["e"] - r["s"])))
    gone = F.aggregate(F.zip_with("_hi", "_lo", lambda h, l: h - l), F.lit(0), lambda a, x: a + x)
    text = F.when(F.col("_lo").isNull(), own(text_col)).otherwise(F.array_join(kept, "\n"))
    facts = F.struct(n.cast("long").alias("n_lines"), F.when(F.col("_lo").isNull(), F.lit(0)).otherwise(gone).cast("long").alias("n_removed"), F.when(F.col("_lo").isNull(), F.lit(0)).otherwise(F.size("_lo")).cast("long").alias("n_runs"))
    return joined.select(*((text if c == text_col else own(c)).alias(c) for c in docs.columns if c != "line_dedup"), facts.alias("line_dedup"))
