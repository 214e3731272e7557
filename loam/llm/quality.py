"""Quality by ordinal cumulative-link regression on graded ratings.

P(grade <= j) = logistic(threshold_j - w . x): one weight vector, shared by all grades, over hashed byte 4-grams (their share of
the text) and the share of words that repeat the one before, and ordered thresholds. Expected grade and the tail probability P(grade >= pass_grade) come from the same fit.

The fit takes at most ``sample`` rated rows, those with the smallest hash of their id; that bound is a parameter and
limits nothing else. All texts are scored whole. The weights are 2^bits numbers, whatever the input.

Defined results: a null or empty text has no features and scores by the thresholds alone; null ratings are no ratings;
repeated ratings of one document count once each if they differ; with fewer than two grades everything passes with
the only grade (0 without ratings); a null id is scored like any other; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import Table, blocks, body, in_arrow, settle
from .ngrams import grams, padded, slots, text_sums

GRAM = 4
#: Features are shares of a text's 4-grams times this, so that weights and thresholds have like sizes.
SCALE = 30.0


def text_slots(data: np.ndarray, off: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(slot at each byte, offsets of the texts, share of each text's words that repeat the word before)."""
    buffer, at = padded(data, off)
    solid = ~np.isin(buffer, np.frombuffer(b" \t\n\x0b\x0c\r", np.uint8))
    edge = np.diff(np.r_[False, solid, False].astype(np.int8))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    length = end - start
    word = grams(buffer, 7)[end - 1] & ((1 << 8 * np.minimum(length, 7)) - 1)
    of = np.searchsorted(at[:-1], start, side="right") - 1
    again = np.r_[False, (word[1:] == word[:-1]) & (length[1:] == length[:-1]) & (of[1:] == of[:-1])][: len(word)]
    share = np.bincount(of, again, minlength=len(off) - 1) / np.maximum(np.bincount(of, minlength=len(off) - 1), 1)
    return slots(grams(buffer, GRAM), bits), at, share


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class CumulativeLink:
    """Weights and thresholds, fitted by Adam on mini-batches of sparse rows."""

    def __init__(self, weights: np.ndarray, thresholds: np.ndarray):
        self.weights, self.thresholds = weights, thresholds

    def tails(self, s: np.ndarray) -> np.ndarray:
        """P(grade >= j) for j = 1 .. grades - 1, as columns."""
        return sigmoid(s[:, None] - self.thresholds[None, :])

    @classmethod
    def fit(cls, slot: np.ndarray, share: np.ndarray, off: np.ndarray, grade: np.ndarray, bits: int, epochs: int = 12, batch: int = 256, rate: float = 0.05, decay: float = 1e-6, seed: int = 7) -> CumulativeLink:
        levels = int(grade.max()) + 1 if len(grade) else 1
        w = np.zeros((1 << bits) + 1)  # the last is for repeated words
        # thresholds as the first one and the logarithms of the gaps, so that they stay ordered
        tail = [np.clip((grade >= j).mean(), 0.01, 0.99) for j in range(1, levels)]
        theta = -np.log(np.array(tail) / (1 - np.array(tail))) if tail else np.zeros(0)
        t = np.r_[theta[:1], np.log(np.maximum(np.diff(theta), 0.1))]
        if levels == 1:
            return cls(w, t)
        g1, g2, t1, t2 = np.zeros_like(w), np.zeros_like(w), np.zeros_like(t), np.zeros_like(t)
        rng, step = np.random.default_rng(seed), 0
        for _ in range(epochs):
            for part in np.array_split(rng.permutation(len(grade)), max(1, len(grade) // batch)):
                step += 1
                size = off[part + 1] - off[part]
                row = np.repeat(np.arange(len(part)), size)
                at = np.repeat(off[part] - (np.cumsum(size) - size), size) + np.arange(size.sum())
                sl, x, y = slot[at], share[at], grade[part]
                s = np.bincount(row, x * w[sl], minlength=len(part))
                gaps = np.r_[t[0], np.exp(t[1:])]
                theta = np.cumsum(gaps)
                high = np.c_[sigmoid(theta[None, :] - s[:, None]), np.ones(len(part))]  # P(grade <= j)
                cum = np.c_[np.zeros(len(part)), high]
                up, lo = cum[np.arange(len(part)), y + 1], cum[np.arange(len(part)), y]
                p = np.maximum(up - lo, 1e-9)
                d_up, d_lo = up * (1 - up) / p, lo * (1 - lo) / p  # d log p / d threshold above and below
                ds = (d_up - d_lo) / len(part)  # of the loss -log p, by s
                dtheta = np.zeros(levels + 1)
                np.add.at(dtheta, y + 1, -d_up / len(part))
                np.add.at(dtheta, y, d_lo / len(part))
                dtheta = dtheta[1:levels]
                dt = np.cumsum(dtheta[::-1])[::-1] * np.r_[1.0, gaps[1:]]
                gw = np.bincount(sl, x * ds[row], minlength=len(w)) + decay * w
                for v, g, m1, m2 in ((w, gw, g1, g2), (t, dt, t1, t2)):
                    m1 += 0.1 * (g - m1)
                    m2 += 0.001 * (g * g - m2)
                    v -= rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-9)
        return cls(w, np.cumsum(np.r_[t[0], np.exp(t[1:])]))


def features(texts: DataFrame, bits: int) -> DataFrame:
    """texts(id, text, grade), a bounded sample -> (id, slots, shares, grade) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, off in blocks(batches, "text"):
            slot, at, again = text_slots(data, off, bits)
            found = [np.unique(slot[a : a + n], return_counts=True) for a, n in zip(at[:-1], np.diff(off))]
            share = [np.r_[c * (SCALE / max(c.sum(), 1)), SCALE * r].astype(np.float32) for (_, c), r in zip(found, again)]
            lists = pa.array([np.r_[f, 1 << bits].astype(np.int32) for f, _ in found], pa.list_(pa.int32())), pa.array(share, pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([rows.column(0), *lists, rows.column(2).cast(pa.int32())], names=["id", "slots", "shares", "grade"])

    return in_arrow(texts, run, "id string, slots array<int>, shares array<float>, grade int")


def ordinal_quality(docs: DataFrame, ratings: DataFrame, id_col: str = "doc_id", text_col: str = "text", pass_grade: int = 1, cut: float = 0.5, sample: int = 6_000, bits: int = 17) -> DataFrame:
    """One row per row of docs: doc_id, expected_grade, tail (P(grade >= pass_grade)), selected (tail >= cut).

    ratings: doc_id and grade, 0 to a small number.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), body(text_col).alias("text"))
    scored = score_quality(docs, fit_quality(docs, ratings, sample, bits), pass_grade)
    return scored.withColumn("selected", F.col("tail") >= cut)


def fit_quality(docs: DataFrame, ratings: DataFrame, sample: int, bits: int) -> CumulativeLink:
    rated = ratings.select(F.col("doc_id"), F.col("grade").cast("int").alias("grade")).filter("grade >= 0 and doc_id is not null").distinct()
    first = [F.xxhash64(F.col("doc_id").cast("string")), "doc_id", "grade"]
    chosen = Table(rated.orderBy(*first).limit(sample), "rated")  # bounded by the parameter
    # features where the texts are; rows that repeat an id are cut to the bound again as features
    got = features(docs.join(F.broadcast(chosen.df), "doc_id").select(F.col("doc_id").cast("string").alias("id"), "text", "grade"), bits)
    table = Table(got, "features")
    settle(docs.sparkSession)
    rows = table.df.orderBy(F.xxhash64("id"), "id", "grade", F.xxhash64("slots", "shares")).limit(sample).select("slots", "shares", "grade").toArrow()
    flat = lambda name, kind: np.concatenate([np.zeros(0, kind), *(c.flatten().to_numpy() for c in rows[name].chunks)])
    size = np.concatenate([np.zeros(0, np.int64), *(np.diff(c.offsets.to_numpy()) for c in rows["slots"].chunks)])
    grade, slot = rows["grade"].to_numpy().copy(), flat("slots", np.int32)
    rows = rows.select(["shares"])  # one column less in memory
    share = flat("shares", np.float32)
    del rows
    model = CumulativeLink.fit(slot, share, np.r_[0, np.cumsum(size)], grade, bits)
    del slot, share
    table.drop(), chosen.drop()
    settle(docs.sparkSession)
    return model


def score_quality(docs: DataFrame, model: CumulativeLink, pass_grade: int) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast((model.weights.astype(np.float32), model.thresholds))
    out = T.StructType([docs.schema["doc_id"], T.StructField("expected_grade", T.DoubleType()), T.StructField("tail", T.DoubleType())])
    arrow = to_arrow_schema(out)
    bits = (len(model.weights) - 1).bit_length() - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, thresholds = sent.value
        for rows, data, off in blocks(batches, "text"):
            tails = tail_of(data, off, weights, thresholds, bits)
            at_least = tails[:, pass_grade - 1] if pass_grade <= tails.shape[1] else np.ones(len(tails))
            yield pa.RecordBatch.from_arrays([rows.column(0).cast(arrow.field(0).type), pa.array(tails.sum(axis=1)), pa.array(at_least)], schema=arrow)

    return in_arrow(docs, run, out)


def keep_quality(docs: DataFrame, ratings: DataFrame, id_col: str = "doc_id", text_col: str = "text", pass_grade: int = 1, cut: float = 0.5, sample: int = 6_000, bits: int = 17) -> DataFrame:
    """The rows of docs, with all their columns, whose tail probability reaches the cut."""
    model = fit_quality(docs.select(F.col(id_col).alias("doc_id"), body(text_col).alias("text")), ratings, sample, bits)
    sent = docs.sparkSession.sparkContext.broadcast((model.weights.astype(np.float32), model.thresholds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, thresholds = sent.value
        for rows, data, off in blocks(batches, text_col):
            yield rows.filter(pa.array(tail_of(data, off, weights, thresholds, bits)[:, pass_grade - 1] >= cut) if len(thresholds) >= pass_grade else pa.array(np.ones(rows.num_rows, bool)))

    return in_arrow(docs, run, docs.schema)


def tail_of(data: np.ndarray, off: np.ndarray, weights: np.ndarray, thresholds: np.ndarray, bits: int) -> np.ndarray:
    """P(grade >= j) of each text, as columns j = 1, 2, ..."""
    slot, at, again = text_slots(data, off, bits)
    size = np.diff(off)
    return CumulativeLink(weights, thresholds).tails(SCALE * (text_sums(weights[slot], at, size) / np.maximum(size, 1) + weights[-1] * again))
