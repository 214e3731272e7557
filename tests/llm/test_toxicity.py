"""The word models against brute force, and the cases without classes, labels or rows."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from loam.llm import toxicity as tox
from loam.llm.toxicity import Ratios, count_words, models, toxicity, word_keys

TEXTS = [
    ("the idiot ran, The dog slept", 1), ("idiots and a clown", 1), ("clown! clown idiot", 1), ("the dog ran to the house", 0),
    ("a house by the sea and the dog", 0), ("dogs sleep; été naïve seaside", 0), ("the sea, the sea-side", 0), ("", 0), ("... 12", 1),
]


def beginnings(text):
    out = set()
    for w in re.findall(rb"[A-Za-z\x80-\xff]+", text.encode()):
        w = (w.lower() + b" ")[: tox.ORDER]
        out.add(w)
    return out


def brute():
    """(class, prefix) counts of texts, and p(byte | prefix) by the formula of the docstring."""
    n = [Counter(), Counter()]
    for text, label in TEXTS:
        for w in beginnings(text):
            n[label].update(w[:k] for k in range(1, len(w) + 1))
    grams = set(n[0]) | set(n[1])
    pooled = Counter({g: n[0][g] + n[1][g] for g in grams})

    def discount(c):
        one, two = (sum(v == k for v in c.values()) for k in (1, 2))
        return one / (one + 2 * two) if one and two else 0.5

    d, dp = [discount(c) for c in n], discount(pooled)
    nexts = defaultdict(list)
    for g in grams:
        nexts[g[:-1]].append(g)
    follows = Counter(g[-1] for g in grams)

    def p(c, g):
        same = nexts[g[:-1]]
        low = 0.99 * follows[g[-1]] / len(grams) + 0.01 / 256
        q = (max(pooled[g] - dp, 0) + dp * len(same) * low) / sum(pooled[x] for x in same)
        types = sum(n[c][x] > 0 for x in same)
        return (max(n[c][g] - d[c], 0) + (tox.PRIOR + d[c] * types) * q) / (sum(n[c][x] for x in same) + tox.PRIOR)

    def back(c, h):
        return (tox.PRIOR + d[c] * sum(n[c][x] > 0 for x in nexts[h])) / (sum(n[c][x] for x in nexts[h]) + tox.PRIOR)

    def word(w):
        total = 0.0
        for k in range(1, len(w) + 1):
            if w[:k] not in grams:
                return total + math.log(back(1, w[: k - 1]) / back(0, w[: k - 1]))
            total += math.log(p(1, w[:k]) / p(0, w[:k]))
        return total

    return grams, p, word


@pytest.fixture(scope="module")
def fitted(spark):
    texts = spark.createDataFrame(TEXTS, "text string, toxic long").repartition(3)
    found, unknown, _ = models(count_words(texts))
    return found.toArrow(), unknown


def test_probabilities(fitted):
    grams, p, _ = brute()
    got = {int(k) & (1 << 64) - 1: (a, b) for k, a, b in zip(*(fitted[0][c].to_pylist() for c in ("key", "p0", "p1")))}
    assert len(got) == len(grams)
    for g in grams:
        a, b = got[int.from_bytes(g.ljust(8, b"\0"), "big")]
        assert a == pytest.approx(p(0, g), abs=1e-9) and b == pytest.approx(p(1, g), abs=1e-9)


def test_word_ratios(fitted):
    _, _, word = brute()
    table = Ratios(fitted[0], fitted[1])
    for w in (b"idiot ", b"clowns ", b"the ", b"thx ", b"zebra ", b"seasides", b"seasidex", "é".encode() + b" "):
        key = np.array([int.from_bytes(w.ljust(8, b"\0"), "big")], np.uint64)
        assert table.get(key)[0] == pytest.approx(word(w), abs=1e-5)


def test_word_keys_never_cross_texts():
    texts = ["ab", "", "cd e", "é", "!", "", "Abcdefghi j"]
    raw = [t.encode() for t in texts]
    key, at = word_keys(np.frombuffer(b"".join(raw), np.uint8), np.r_[0, np.cumsum([len(r) for r in raw])])
    words = [int(k).to_bytes(8, "big").rstrip(b"\0") for k in key]
    assert [words[a:b] for a, b in zip(at[:-1], at[1:])] == [[b"ab "], [], [b"cd ", b"e "], ["é".encode() + b" "], [], [], [b"abcdefgh", b"j "]]


def cut(word):
    """The pieces of one word, by whole characters."""
    chars, out, at = [c.encode() for c in word], [], 0
    where = [sum(map(len, chars[:i])) for i in range(len(chars))]
    size = sum(map(len, chars))
    if size > tox.LONG:
        out = where
    else:
        while at < size:
            out.append(at)
            at = max([w for w in where if w <= at + tox.ORDER], default=0) if at + tox.ORDER < size else size
    raw = b"".join(chars).lower() + b" "
    return [raw[w : w + tox.ORDER] for w in out]


def test_every_byte_is_in_a_key():
    words = ["a", "abcdefgh", "abcdefghi", "Abcdefghijklmnopq", "x" * 32, "xy" * 17, "字" * 2, "字" * 3, "字" * 10, "字天" * 40, "aé" * 9, "😀a" * 6, "😀" * 9, "naïveté" * 2]
    texts = ["".join(w) for w in words] + ["", " ".join(words), "! " + words[9] + "," + words[5]]
    raw = [t.encode() for t in texts]
    key, at = word_keys(np.frombuffer(b"".join(raw), np.uint8), np.r_[0, np.cumsum([len(r) for r in raw])], whole=True)
    got = [int(k).to_bytes(8, "big").rstrip(b"\0") for k in key]
    want = [*([w] for w in words), [], words, [words[9], words[5]]]
    assert [got[a:b] for a, b in zip(at[:-1], at[1:])] == [[p for w in ws for p in cut(w)] for ws in want]
    for w in words:
        assert len(cut(w)) >= len(w.encode()) / tox.ORDER


@pytest.mark.parametrize("broadcast", [8_000_000, 0])
def test_texts_without_blanks(spark, broadcast):
    """What is said late in an unbroken text, or late in a long word, counts."""
    rng = np.random.default_rng(5)
    filler = lambda n: "".join(rng.choice(list("天地人日月山水火木金土石田川"), n))
    rows, labels = [], []
    for i in range(300):
        bad = i % 4 == 0
        text = filler(30 + i % 7) + ("罵詈雑言" if bad else "") + filler(5) if i % 2 == 0 else f"ordinary words and gegenstand{'schimpf' if i % 3 == 0 else 'freund'}"
        rows.append((i, text))
        labels.append((i, int(bad if i % 2 == 0 else i % 3 == 0)))
    got = toxicity(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"), broadcast=broadcast).collect()
    held = [(r["predicted"], labels[r["doc_id"]][1]) for r in got if r["held_out"]]
    assert len(held) > 40 and sum(p == t for p, t in held) >= 0.95 * len(held)


def corpus(spark):
    rows = [(i, f"w{i % 7} common words here " * 3 + ("zorgle qwix" if i % 4 == 0 else "")) for i in range(200)]
    rows += [rows[5], rows[5], (200, None), (None, "zorgle"), (201, "")]
    labels = [(i, int(i % 4 == 0)) for i in range(200)] + [(3, 0), (7, None), (None, 1)]
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def key(r):
    return str(r[0]), r[4]


def test_join_gives_what_the_table_gives(spark):
    docs, labels = corpus(spark)
    one, two = (sorted(map(tuple, toxicity(docs, labels, broadcast=b).collect()), key=key) for b in (8_000_000, 0))
    assert len(one) == 205 and [r[:2] for r in one] == [r[:2] for r in two]
    assert np.allclose([r[2:] for r in one], [r[2:] for r in two], atol=1e-6)
    held = [r for r in one if r[1] and r[0] is not None and r[0] < 200]
    assert held and all(r[3] == (r[0] % 4 == 0) for r in held)


def test_without_classes_labels_or_rows(spark):
    docs, labels = corpus(spark)
    for kept, most in ((labels.limit(0), 0.0), (labels.withColumn("toxic", F.lit(None).cast("int")), 0.0), (labels.withColumn("toxic", F.lit(0)), 0.1)):
        got = toxicity(docs, kept).collect()
        assert len(got) == 205 and all(r["score"] <= most and r["predicted"] == 0 for r in got)
    assert all(r["predicted"] == 1 for r in toxicity(docs, labels.withColumn("toxic", F.lit(1))).collect())
    assert toxicity(docs.limit(0), labels).count() == 0
