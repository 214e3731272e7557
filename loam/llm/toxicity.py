"""Toxicity by class-conditional Kneser-Ney models of words.

Two models, one of texts marked toxic and one of the others, predict each byte of a word from all bytes of the word before it, up to
ORDER bytes with the blank that ends the word; words are runs of letters (A-Z folded; every byte of a character beyond ASCII counts as a letter).
What goes on behind ORDER bytes is taken as further words, so every byte of a text counts: in a word of up to LONG bytes every ORDER bytes,
in a longer run, as of scripts without blanks, from each character on. A text counts each of its word beginnings once. A class's counts are discounted by its Kneser-Ney discount, and what that frees, and
PRIOR further counts, go to one shared model of the pooled counts:

    p_c(x | h) = (max(n_c(hx) - D_c, 0) + (PRIOR + D_c types_c(h)) q(x | h)) / (n_c(h) + PRIOR)

q is the same for both classes: interpolated Kneser-Ney of the pooled counts over the continuation counts of bytes (in how many contexts
x was seen). So where neither class has seen an expression, or only rarely, both back off to one model and it adds little or nothing.

A word's log-ratio is the sum over its bytes, from its start to the first one that no class has seen. A passage of PASSAGE words has
the mean of its words' log-ratios: the difference of the two log-likelihoods for its length. A text is as toxic as its worst passage;
a text with fewer words is one passage (of the full length). A logistic curve, fitted on labelled rows that gave no counts, makes it a score.

Counts cover every labelled training row. They are aggregated and the models are computed by Spark. What scoring looks up, two
numbers for each beginning seen, grows with the corpus; up to ``broadcast`` beginnings it goes to the executors as an exact sorted table
of 16 bytes each, beyond that the distinct beginnings of the texts are joined with it.

Defined results: a null or empty text has ratio 0 and is scored by the curve's offset; null labels are no labels; a null id has no
label and is not held out; repeated labels count once; if one class has no rows to count, all ratios are 0, and where the curve's rows hold one class
it is flat, at (ones + 1/2) / (ones + zeros + 1); without labels every score is 0; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import Table, blocks, body, in_arrow, small_side

ORDER = 8
PRIOR = 30.0
PASSAGE = 5
#: Bytes of the longest run of letters that is taken for one word.
LONG = 32
#: A byte of no letter, so that a whole word differs from the beginning of a longer one.
END = 0x20
LETTER = np.zeros(256, bool)
LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
FOLDED = np.arange(256, dtype=np.uint64)
FOLDED[0x41:0x5B] += np.uint64(0x20)


def fold(id_col: str | Column) -> Column:
    """crc32 of the id as text, mod 5."""
    return F.crc32(F.col(id_col).cast("string").cast("binary") if isinstance(id_col, str) else id_col) % 5


def pieces(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of each word and of what goes on behind its first ORDER bytes, in order: every byte of a word is in some piece.

    A word of up to LONG bytes goes on every ORDER bytes, so that equal words have equal pieces; a longer run, as of scripts without blanks, with
    every character, as what is said in it can begin anywhere. Pieces begin with whole characters.
    """
    inside = (data & 0xC0) == 0x80
    starts, ends = [start], [end]
    at, to = (x[(end - start > ORDER) & (end - start <= LONG)] for x in (start, end))
    while len(at):
        at = at + ORDER
        for _ in range(3):
            at = at - inside[np.minimum(at, len(data) - 1)] * (at < to)
        at, to = at[at < to], to[at < to]
        starts.append(at), ends.append(to)
    first, last = (x[end - start > LONG] for x in (start, end))
    if len(first):
        edge = np.zeros(len(data) + 1, np.int8)
        edge[first] += 1
        edge[last] -= 1
        within = np.cumsum(edge[:-1]) > 0
        within[first] = False
        at = np.flatnonzero(within & ~inside)
        starts.append(at), ends.append(last[np.searchsorted(last, at, side="right")])
    start, end = np.concatenate(starts), np.concatenate(ends)
    by = np.argsort(start, kind="stable")
    return start[by], end[by]


def word_keys(data: np.ndarray, off: np.ndarray, whole: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(key of each word, n + 1 offsets of the texts in it): the first ORDER bytes of a word and its end, the first one highest, zeros behind.

    whole: keys of all pieces of the words, so that no byte of a text is left out.
    """
    solid = np.zeros(len(data) + 2, np.int8)
    solid[1:-1] = LETTER[data]
    edge = np.diff(solid)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    inner = off[1:-1][(off[1:-1] > 0) & (off[1:-1] < len(data))]
    cut = np.unique(inner[LETTER[data[inner]] & LETTER[data[inner - 1]]]) if len(inner) else inner  # words never cross texts
    start, end = np.sort(np.r_[start, cut]), np.sort(np.r_[end, cut])
    if whole:
        start, end = pieces(data, start, end)
    size, padded = end - start, np.r_[data, np.zeros(ORDER, np.uint8)]
    key = np.zeros(len(start), np.uint64)
    for i in range(ORDER):
        byte = np.where(size > i, FOLDED[padded[start + i]], np.where(size == i, np.uint64(END), np.uint64(0)))
        key |= byte << np.uint64(56 - 8 * i)
    return key, np.searchsorted(start, off)


def beginning(key: np.ndarray, k: int) -> np.ndarray:
    """The first k bytes of keys."""
    return key & np.uint64((1 << 64) - (1 << (64 - 8 * k)))


def signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def count_words(texts: DataFrame) -> DataFrame:
    """texts(text, toxic) -> (key, n0, n1): in how many ordinary and toxic texts a word begins so."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, off in blocks(batches, "text"):
            key, at = word_keys(data, off, whole=True)
            of = np.repeat(np.arange(len(off) - 1), np.diff(at))
            by = np.lexsort((of, key))
            new = np.r_[True, (np.diff(key[by]) != 0) | (np.diff(of[by]) != 0)][: len(by)]
            key, label = key[by][new], rows.column(1).to_numpy()[of[by][new]]
            first = np.flatnonzero(np.r_[True, np.diff(key) != 0][: len(key)])
            n1 = np.add.reduceat(label, first) if len(first) else label
            yield pa.RecordBatch.from_arrays([pa.array(key[first].view(np.int64)), pa.array(np.diff(np.r_[first, len(key)]) - n1), pa.array(n1)], names=["key", "n0", "n1"])

    return in_arrow(texts, run, "key long, n0 long, n1 long").groupBy("key").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def discount(n: str) -> Column:
    """n1 / (n1 + 2 n2) of the counts of counts; a half where they tell nothing."""
    one, two = F.sum((F.col(n) == 1).cast("double")), F.sum((F.col(n) == 2).cast("double"))
    return F.when(one * two > 0, one / (one + 2 * two)).otherwise(F.lit(0.5))


def models(counts: DataFrame) -> tuple[DataFrame, float, list[Table]]:
    """counts(key, n0, n1) of whole keys -> (depth, key, p0, p1, own, beyond) for each beginning that was seen, and the log-ratio of a word without one.

    p0, p1: probability of its last byte after the others, in each class; own: log-ratio of the beginning; beyond: log-ratio of
    a word that goes on from there with a byte that no class has seen.
    """
    byte = lambda k: F.shiftrightunsigned("key", 64 - 8 * k).bitwiseAND(0xFF)
    cut = lambda k: F.col("key").bitwiseAND(F.lit(signed((1 << 64) - (1 << (64 - 8 * k))))) if k else F.lit(0).cast("long")
    every = F.explode(F.filter(F.array(*(F.when(byte(k) > 0, F.struct(F.lit(k).alias("depth"), cut(k).alias("key"), cut(k - 1).alias("context"), byte(k).alias("byte"))) for k in range(1, ORDER + 1))), lambda x: x.isNotNull()))
    grams = counts.select(every.alias("g"), "n0", "n1").groupBy("g.depth", "g.key", "g.context", "g.byte").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    grams = Table(grams.withColumn("n", F.col("n0") + F.col("n1")), "grams")
    g = grams.df
    d = g.agg(*(discount(f"n{c}").alias(f"d{c}") for c in ("0", "1", ""))).first()
    d = {c: d[f"d{c}"] for c in ("0", "1", "")}
    next_depth = g.groupBy((F.col("depth") - 1).alias("depth"), F.col("context").alias("key"))
    contexts = Table(next_depth.agg(*(x for c in ("0", "1", "") for x in (F.sum(f"n{c}").alias(f"tot{c}"), F.count_if(F.col(f"n{c}") > 0).alias(f"types{c}")))), "contexts")
    seen_in = g.groupBy("byte").agg(F.count(F.lit(1)).alias("follows"))  # at most 256 rows
    kinds = g.count() or 1

    after = contexts.df.select((F.col("depth") + 1).alias("depth"), F.col("key").alias("context"), *(c for c in contexts.df.columns if c not in ("depth", "key")))
    rows = g.join(after, ["depth", "context"]).join(F.broadcast(seen_in), "byte")
    low = F.lit(0.99) * F.col("follows") / F.lit(float(kinds)) + F.lit(0.01 / 256)
    q = (F.greatest(F.col("n") - d[""], F.lit(0.0)) + F.lit(d[""]) * F.col("types") * low) / F.col("tot")
    p = {c: (F.greatest(F.col(f"n{c}") - d[c], F.lit(0.0)) + (F.lit(PRIOR) + F.lit(d[c]) * F.col(f"types{c}")) * q) / (F.col(f"tot{c}") + F.lit(PRIOR)) for c in ("0", "1")}
    steps = Table(rows.select("depth", "key", "context", p["0"].alias("p0"), p["1"].alias("p1")), "steps")
    back = lambda c: (F.lit(PRIOR) + F.lit(d[c]) * F.col(f"types{c}")) / (F.col(f"tot{c}") + F.lit(PRIOR))
    on = contexts.df.select("depth", "key", F.log(back("1") / back("0")).alias("on"))
    made, above, found = [grams, contexts, steps], None, None
    for k in range(1, ORDER + 1):  # sums along the beginnings of each beginning
        level = steps.df.filter(F.col("depth") == k).withColumn("step", F.log(F.col("p1") / F.col("p0")))
        level = level.withColumn("own", F.col("step")) if above is None else level.join(above, "context").withColumn("own", F.col("step") + F.col("before"))
        table = Table(level.select("depth", "key", "p0", "p1", "own"), f"sums{k}")
        made.append(table)
        above = table.df.select(F.col("key").alias("context"), F.col("own").alias("before"))
        found = table.df if found is None else found.unionByName(table.df)
    # a whole word has no bytes behind it
    found = found.join(on, ["depth", "key"], "left").withColumn("beyond", F.col("own") + F.coalesce("on", F.lit(0.0))).drop("on")
    return found, on.filter("depth = 0").first()["on"], made


class Ratios:
    """Exact sorted table of all beginnings seen, with own and beyond; unknown is the log-ratio of a word whose first byte is not seen."""

    def __init__(self, found: pa.Table, unknown: float):
        key = found["key"].to_numpy().view(np.uint64)
        by = np.argsort(key)
        self.key, self.own, self.beyond = key[by], found["own"].to_numpy()[by].astype(np.float32), found["beyond"].to_numpy()[by].astype(np.float32)
        self.unknown = np.float32(unknown)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The log-ratio of each word."""
        distinct, where = np.unique(keys, return_inverse=True)
        out = np.zeros(len(distinct), np.float32)
        left = np.arange(len(distinct)) if len(self.key) else np.zeros(0, int)
        for k in range(ORDER, 0, -1):
            want = beginning(distinct[left], k)
            at = np.minimum(np.searchsorted(self.key, want), len(self.key) - 1)
            hit = self.key[at] == want
            whole = want[hit] == distinct[left[hit]]
            out[left[hit]] = np.where(whole, self.own[at[hit]], self.beyond[at[hit]])
            left = left[~hit]
        out[left] = self.unknown
        return out[where]


def passages(ratio: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The highest passage of each text: ratio of each word, offsets of the texts."""
    n, count = len(at) - 1, np.diff(at)
    total = np.r_[0.0, np.cumsum(ratio, dtype=np.float64)]
    out = np.zeros(n)
    if not len(ratio):
        return out
    end = np.repeat(at[1:], count)
    i = np.arange(len(ratio))
    ends = np.minimum(i + PASSAGE, end)
    mean = (total[ends] - total[i]) / PASSAGE
    mean[(i + PASSAGE > end) & (i != np.repeat(at[:-1], count))] = -np.inf  # only whole passages, or the whole text
    full = np.flatnonzero(count)
    out[full] = np.maximum.reduceat(mean, at[:-1][full])
    return out


def fit_curve(bins: np.ndarray, ones: np.ndarray, zeros: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Logistic a * x + b by Newton steps on counted bins, with a weak prior against infinite slopes."""
    if not len(bins):
        return 0.0, -np.inf
    if not ones.sum() or not zeros.sum():
        return 0.0, float(np.log((ones.sum() + 0.5) / (zeros.sum() + 0.5)))
    scale = np.sqrt(np.average(bins**2, weights=ones + zeros)) or 1.0
    x = np.stack((bins / scale, np.ones(len(bins))))
    n, w = ones + zeros, np.array([0.0, np.log(ones.sum() / zeros.sum())])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(w @ x, -30, 30)))
        grad = x @ (ones - n * p) - 0.01 * w * (1, 0)
        hess = (x * (n * p * (1 - p))) @ x.T + np.diag((0.01, 1e-9))
        step = np.linalg.solve(hess, grad)
        w = w + step * min(1.0, 4.0 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0] / scale), float(w[1])


def scored(docs: DataFrame, look_up: Callable[[pa.RecordBatch, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """docs(doc_id, text, ...) -> (doc_id, ratio); look_up(rows, data, off) gives the words' log-ratios and the texts' offsets in them."""
    out = T.StructType([docs.schema["doc_id"], T.StructField("ratio", T.DoubleType())])
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, off in blocks(batches, "text"):
            yield pa.RecordBatch.from_arrays([rows.column(0).cast(arrow.field(0).type), pa.array(passages(*look_up(rows, data, off)))], schema=arrow)

    return in_arrow(docs, run, out)


def scored_by_join(docs: DataFrame, found: DataFrame, unknown: float) -> tuple[DataFrame, list[Table]]:
    """As scored, for models too large for one machine: the distinct keys of all texts are joined with their longest beginning seen, and each text gets the
    log-ratios of its own distinct keys with it."""
    own = docs.withColumn("tag", F.xxhash64("text"))

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, off in blocks(batches, "text"):
            key, at = word_keys(data, off, whole=True)
            lists = [np.unique(key[a:b]).view(np.int64) for a, b in zip(at[:-1], at[1:])]
            tag = np.repeat(rows.column(0).to_numpy(), [len(x) for x in lists])
            yield pa.RecordBatch.from_arrays([pa.array(tag), pa.array(np.concatenate([np.zeros(0, np.int64), *lists]))], names=["tag", "key"])

    words = Table(in_arrow(own.select("tag", "text").dropDuplicates(["tag"]), keys, "tag long, key long"), "words")
    distinct = words.df.select("key").distinct()
    cut = lambda k: F.col("key").bitwiseAND(F.lit(signed((1 << 64) - (1 << (64 - 8 * k)))))
    starts = distinct.select("key", F.explode(F.array(*(cut(k) for k in range(1, ORDER + 1)))).alias("b")).distinct()
    seen = starts.join(found.select(F.col("key").alias("b"), "depth", "own", "beyond"), "b")
    best = seen.groupBy("key").agg(F.max_by(F.when(F.col("b") == F.col("key"), F.col("own")).otherwise(F.col("beyond")), "depth").alias("r"))
    of_text = words.df.join(best, "key", "left").groupBy("tag").agg(F.collect_list(F.struct("key", F.coalesce("r", F.lit(unknown)).cast("float").alias("r"))).alias("known"))
    joined = own.join(of_text, "tag", "left").select("doc_id", "text", "known")

    def look_up(rows: pa.RecordBatch, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key, at = word_keys(data, off, whole=True)
        out = np.zeros(len(key), np.float32)
        for known, a, b in zip(rows.column(2), at[:-1], at[1:]):
            if b > a:
                k, r = (known.values.field(i).to_numpy() for i in (0, 1))
                by = np.argsort(k)
                out[a:b] = r[by][np.searchsorted(k[by], key[a:b].view(np.int64))]
        return out, at

    return scored(joined, look_up), [words]


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", count_folds: tuple[int, ...] = (1, 2, 3), curve_folds: tuple[int, ...] = (4,), broadcast: int = 8_000_000) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted, ratio. Folds are crc32(id as text) mod 5; 0 is held out.

    broadcast: how many beginnings the executors' table may hold.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), body(text_col).alias("text"))
    labelled = Table(labels.select(F.col("doc_id"), F.col(label_col).cast("int").alias("toxic")).filter("toxic in (0, 1)").distinct(), "labels")
    labels = small_side(labelled.df, labelled.df.count())
    training = labels.filter(fold("doc_id").isin(*count_folds))
    counts = Table(count_words(docs.join(training, "doc_id").select("text", F.col("toxic").cast("long").alias("toxic"))), "words")
    made = [labelled, counts]
    classes = counts.df.agg(F.coalesce(F.sum("n0"), F.lit(0)), F.coalesce(F.sum("n1"), F.lit(0))).first()
    if all(classes):
        found, unknown, more = models(counts.df)
        made += more
        kept = Table(found.select("depth", "key", "own", "beyond"), "ratios")
        made.append(kept)
        if kept.df.count() <= broadcast:
            model = docs.sparkSession.sparkContext.broadcast(Ratios(kept.df.select("key", "own", "beyond").toArrow(), unknown))

            def look_up(rows: pa.RecordBatch, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
                key, at = word_keys(data, off, whole=True)
                return model.value.get(key), at

            ratio = scored(docs, look_up)
        else:
            ratio, more = scored_by_join(docs, kept.df, unknown)
            made += more
    else:
        ratio = docs.select("doc_id", F.lit(0.0).alias("ratio"))
    rows = Table(ratio, "ratios").df
    # the curve: counted bins of the ratio, a bounded summary of all labelled rows of its folds
    bins = rows.join(labels.filter(fold("doc_id").isin(*curve_folds)), "doc_id").groupBy(F.round(F.least(F.greatest("ratio", F.lit(-8.0)), F.lit(8.0)) * 2048).alias("bin")).agg(F.sum("toxic").alias("ones"), F.sum(1 - F.col("toxic")).alias("zeros")).toArrow()
    a, b = fit_curve(bins["bin"].to_numpy() / 2048, bins["ones"].to_numpy().astype(float), bins["zeros"].to_numpy().astype(float))
    for table in made:
        table.drop()
    score = F.lit(0.0) if b == -np.inf else 1 / (1 + F.exp(-F.greatest(F.least(F.col("ratio") * a + b, F.lit(500.0)), F.lit(-500.0))))
    return rows.select("doc_id", F.coalesce(fold("doc_id") == 0, F.lit(False)).alias("held_out"), score.alias("score"), (score >= 0.5).cast("int").alias("predicted"), "ratio")
