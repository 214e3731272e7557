"""The llm operators against brute force on small tables with nulls, empty and repeated rows, ties and extra columns."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

from loam.llm.bpe import decode, encode, read_ranks
from loam.llm.exact_dedup import exact_dedup
from loam.llm.line_dedup import line_dedup
from loam.llm.mixing import mix
from loam.llm.quality import keep_quality, ordinal_quality
from loam.llm.simhash import covering_masks, simhash_components
from loam.llm.suffix_dedup import remove_repeats
from loam.llm.topk import top_k
from loam.llm.toxicity import toxicity
from loam.llm.url_filter import url_filter

SCHEMA = "doc_id long, text string, source string, kept string, tag string, name string"
PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    words = ["alpha", "Beta", "gamma,", "delta", "été", "don't", "42", "naïve"]
    line = lambda n: " ".join(rng.choice(words) for _ in range(n))
    shared = [line(30) for _ in range(3)]
    out = []
    for i in range(30):
        body = [line(rng.randrange(1, 25)) for _ in range(3)]
        if i % 3 == 0:
            body[1:1] = shared
        out.append((i, "\n".join(body), f"s{i % 3}", "x", "y", "z"))
    out += [(30, None, None, None, None, None), (31, "", "s1", None, None, None), (32, out[4][1].upper(), "s1", "k", "t", "n"), (33, "word " * 3000, "s2", None, None, None), out[5], (None, out[7][1], "s0", None, None, None)]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_exact_dedup(docs, rows, empty):
    lower = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    got = exact_dedup(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        same = [x[0] for x in rows if hashlib.sha256(lower(x[1]).encode()).hexdigest() == r["text_sha256"]]
        assert r["group_size"] == len(same) and r["keep_id"] == max((x for x in same if x is not None), default=None)
    assert sum(r["kept"] for r in got) == len({lower(x[1]) for x in rows})
    assert exact_dedup(empty).count() == 0


def test_bpe_round_trip(docs, rows, empty):
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(PATH), special_tokens={})
    coded = encode(docs, PATH, decoded=True)
    want = {(x[0], tuple(enc.encode_ordinary(x[1] or ""))) for x in rows}
    assert {(r["doc_id"], tuple(r["ids"])) for r in coded.collect()} == want
    back = {(r["doc_id"], bytes(r["decoded"]).decode()) for r in decode(coded.select("doc_id", "ids"), PATH).collect()}
    assert back == {(x[0], x[1] or "") for x in rows}
    assert encode(empty, PATH).count() == 0


def test_topk(spark):
    rng = np.random.default_rng(1)
    v = [(i, [int(x) for x in rng.integers(-4, 5, 6)]) for i in range(90)] + [(90, [0] * 6)]
    df = spark.createDataFrame(v, "vec_id long, v array<long>")
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in top_k(df, df.filter("vec_id % 10 = 0"), 5, block=20, query_block=4).collect()}
    for q, x in v[::10]:
        best = sorted(((-int(np.dot(x, y)), i) for i, y in v if i != q))[:5]
        assert [got[q, k] for k in range(1, 6)] == [(i, -s) for s, i in best]


def test_remove_repeats(docs, rows, empty):
    got = {(r["doc_id"], r["n_bytes"]): bytes(r["kept"]) for r in remove_repeats(docs).collect()}
    seen: set = set()
    for i, t in sorted({(x[0], x[1]) for x in rows}, key=lambda x: (x[0] is not None, x[0] or 0)):
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - 99):
            if b[p : p + 100] in seen:
                gone[p : p + 100] = True
            seen.add(b[p : p + 100])
        assert got[i, len(b)] == bytes(np.frombuffer(b, np.uint8)[~gone])
    assert remove_repeats(empty).count() == 0


@pytest.mark.parametrize("least", [1, 2, 3])
def test_line_dedup(docs, rows, empty, least):
    got = {(r["doc_id"], r["line_dedup"]["n_lines"], r["text"] or "") for r in line_dedup(docs, min_lines=least).collect()}
    seen: set = set()
    want = set()
    for i, t in sorted({(x[0], x[1]) for x in rows}, key=lambda x: (x[0] is not None, x[0] or 0)):
        lines = (t or "").split("\n")
        gone = set()
        for p in range(len(lines) - least + 1):
            w = tuple(lines[p : p + least])
            if w in seen:
                gone |= set(range(p, p + least))
            seen.add(w)
        want.add((i, len(lines), "\n".join(x for p, x in enumerate(lines) if p not in gone)))
    assert got == want
    assert line_dedup(empty).count() == 0


def test_masks_cover():
    for r in (1, 2, 3):
        masks = covering_masks(r)
        rng = random.Random(r)
        for _ in range(500):
            bits = sum(1 << b for b in rng.sample(range(64), r))
            assert any(m & bits == 0 for m in masks)


def test_simhash(docs, rows, empty):
    def prints(t):
        w = (t or "").encode().lower().split()
        s = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
        h = [xxhash.xxh64_intdigest(x, 42) for x in s]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    p = [(x[0], prints(x[1])) for x in rows]
    group = list(range(len(p)))
    for _ in p:
        for a in range(len(p)):
            for b in range(len(p)):
                if (p[a][1] ^ p[b][1]).bit_count() <= 2:
                    group[a] = group[b] = min(group[a], group[b])
    want = sorted(((p[a][0], f"{p[a][1]:016x}", min((p[b][0] for b in range(len(p)) if group[b] == group[a] and p[b][0] is not None), default=None)) for a in range(len(p))), key=str)
    assert sorted(map(tuple, simhash_components(docs).collect()), key=str) == want
    assert simhash_components(empty).count() == 0


def test_mixing(docs, empty):
    got = mix(docs, repeat_limit=1.5, block_tokens=40).select("source", "mix.*").collect()
    total, once = {}, {}
    for r in got:
        key = r["source"]
        total[key] = total.get(key, 0) + r["n_tokens"]
        if r["epoch"] == 0:
            once[key] = once.get(key, 0) + r["n_tokens"]
    assert all(1 <= total[k] / once[k] <= 1.5 for k in total if once[k])
    assert mix(empty).count() == 0


def test_url_filter(spark):
    caps = spark.createDataFrame([("http://a.b.com/x/y?q", 5), ("http://a.b.com/x/y?q", 5), ("http://b.com", 1), ("https://c.org/z", 9), (None, 3), ("http://b.com", None)], "url string, fetched int")
    lists = spark.createDataFrame([("b.com", "add", 2), ("b.com", "remove", 6), ("c.org/z", "add", 9), ("c.org", "add", 1), ("c.org", "remove", 1), (None, "add", 1)], "key string, action string, since int")
    got = [(r["url"], r["fetched"], r["url_filter"]["blocked"], r["url_filter"]["n_hits"]) for r in url_filter(caps, lists).collect()]
    assert sorted(got, key=str) == sorted([("http://a.b.com/x/y?q", 5, True, 1)] * 2 + [("http://b.com", 1, False, 0), ("https://c.org/z", 9, True, 1), (None, 3, False, 0), ("http://b.com", None, False, 0)], key=str)
    assert not any(r["url_filter"]["blocked"] for r in url_filter(caps, lists.limit(0)).collect())


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefg") for _ in range(5)) for _ in range(60)]
    out = []
    for i in range(300):
        toxic, bad = i % 5 == 0, i % 7 == 0
        w = [rng.choice(words) for _ in range(60)] + (["zorgle", "qwixxo"] * 3 if toxic else [])
        rng.shuffle(w)
        out.append((i, "!! ".join(w).upper() if bad else " ".join(w), int(toxic), int(not bad)))
    out.append((300, None, None, None))
    return spark.createDataFrame(out, "doc_id long, text string, toxic int, quality int")


def test_toxicity(labelled):
    got = toxicity(labelled.select("doc_id", "text"), labelled.select("doc_id", "toxic")).join(labelled, "doc_id", "left").collect()
    held = [r for r in got if r["held_out"] and r["toxic"] is not None and r["quality"]]
    assert len(got) == 301 and all(0 <= r["score"] <= 1 for r in got)
    assert np.mean([r["predicted"] == r["toxic"] for r in held]) > 0.9


def test_quality(labelled):
    grades = labelled.filter("doc_id % 3 > 0").select("doc_id", (F.col("quality") * (2 - F.col("toxic"))).alias("grade"))
    got = ordinal_quality(labelled, grades).join(labelled, "doc_id").filter("doc_id % 3 = 0 and quality is not null").collect()
    assert np.mean([r["selected"] == bool(r["quality"]) for r in got]) > 0.95
    assert set(keep_quality(labelled, grades).columns) == set(labelled.columns)
    assert ordinal_quality(labelled, grades.limit(0)).filter("not selected").count() == 0
