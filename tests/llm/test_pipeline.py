"""The pipeline's stages, each against brute force on its own input, and names that clash with the operators' own."""

import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
import tiktoken
import xxhash

import corpus_pipeline
from loam.llm.bpe import read_ranks
from loam.llm.line_dedup import line_dedup
from loam.llm.mixing import mix
from loam.llm.url_filter import url_filter

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    """Good texts of common words, bad ones of shouted noise; copies, near copies, repeated lines, nulls and an empty text."""
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(200)]
    line = lambda n: " ".join(rng.choice(words) for _ in range(n))
    shared = [line(12), line(12)]
    rows = []
    for i in range(160):
        body = [line(40), line(40), line(40)]
        if i % 20 == 3:
            body[1:1] = shared
        text = "!! ".join("\n".join(body).split(" ")).upper() if i % 8 == 7 else "\n".join(body)
        rows.append((i, text, "en", f"s{min(i % 10, 3)}", len(text)))
    near = rows[10][1].rsplit(" ", 1)[0] + " changed"
    for text in (rows[5][1], rows[5][1].swapcase(), near, "", None, "one two"):
        rows.append((len(rows), text, None, "s1" if text else "bare", len(text or "")))
    home = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, DOCUMENTS).repartition(3).write.parquet(f"{home}/documents.parquet")
    labels = [(i, int(i % 8 != 7), 0) for i in range(0, 160) if i % 3]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{home}/labels.parquet")
    return home


@pytest.fixture(scope="module")
def steps(spark, sf_dir, tmp_path_factory):
    """The rows before and after each stage, as the driver writes and reads them."""
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        path = f"{tmp_path_factory.mktemp(name)}/rows"
        stage(spark, docs, sf_dir).write.parquet(path)
        after = spark.read.parquet(path)
        out[name] = [tuple(r) for r in docs.collect()], [tuple(r) for r in after.collect()]
        if name != "tokens":
            assert after.columns == docs.columns
        docs = after
    return out


def test_quality_stage(steps):
    before, after = steps["quality"]
    assert set(after) <= set(before)
    kept = {r[0] for r in after}
    good = [r[0] for r in before if r[0] < 160 and r[0] % 8 != 7]
    bad = [r[0] for r in before if r[0] < 160 and r[0] % 8 == 7]
    assert kept >= set(good) and not kept & set(bad)


def test_lines_stage(steps):
    before, after = steps["lines"]
    seen, want = set(), {}
    for i, text, *rest in sorted(before):
        lines, gone = (text or "").split("\n"), set()
        for p in range(len(lines) - 1):
            if tuple(lines[p : p + 2]) in seen:
                gone |= {p, p + 1}
            seen.add(tuple(lines[p : p + 2]))
        if len(gone) < len(lines):
            left = "\n".join(x for p, x in enumerate(lines) if p not in gone) if gone else text
            want[i] = (i, left, *rest[:2], len(left) if gone else rest[2])
    assert {r[0]: r for r in after} == want and len(after) == len(want)


def bits(text):
    w = (text or "").encode().lower().split()
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 5]), 42) for i in range(max(1, len(w) - 4))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_near_copies_stage(steps):
    before, after = steps["near_copies"]
    prints = {r[0]: bits(r[1]) for r in before}
    least = {i: i for i in prints}
    for _ in prints:
        changed = False
        for a in prints:
            for b in prints:
                if (prints[a] ^ prints[b]).bit_count() <= 4 and least[b] < least[a]:
                    least[a], changed = least[b], True
        if not changed:
            break
    assert sorted(r[0] for r in after) == sorted(i for i in least if least[i] == i)
    assert set(after) <= set(before)


def test_mixture_stage(steps):
    before, after = steps["mixture"]
    shown = Counter(after)
    assert set(shown) == set(before)  # none is lost or changed
    size = lambda rows: Counter({s: sum(n * len((r[1] or "").split()) for r, n in rows.items() if r[3] == s) for s in {r[3] for r in rows}})
    once, all_ = size(Counter(before)), size(shown)
    ratio = {s: all_[s] / once[s] for s in once if once[s]}
    assert min(ratio.values()) >= 1 and max(ratio.values()) <= 2.0


def test_tokens_stage(steps):
    before, after = steps["tokens"]
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    want = Counter((r[0], tuple(enc.encode_ordinary(r[1] or "")), hashlib.sha256((r[1] or "").encode()).hexdigest()) for r in before)
    assert Counter((i, tuple(ids), sha) for i, n, ids, sha in after) == want
    assert all(n == len(ids) for _, n, ids, _ in after)


def test_run_is_the_stages_in_order(spark, sf_dir, steps):
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in corpus_pipeline.run(spark, sf_dir).collect()) == Counter((i, tuple(ids)) for i, _, ids, _ in steps["tokens"][1])


def test_stages_on_an_empty_table(spark, sf_dir):
    docs = spark.createDataFrame([], DOCUMENTS)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf_dir).count() == 0


CLASH = "doc_id long, text string, source string, weight int, size int, `left` int, blocks int, epochs int, _lo int, _hi int, _id int, _tag int, row int, name int"


def test_clashing_names(spark):
    rows = [(1, "a b\nc\nd\nc\nd", "x", *range(11)), (2, "", "bare", *range(11)), (3, None, None, *[None] * 11), (None, "q q", "x", *range(11))]
    docs = spark.createDataFrame(rows, CLASH)
    got = line_dedup(docs)
    assert got.columns == [*docs.columns, "line_dedup"]
    assert {(r["doc_id"], r["text"]) for r in got.collect()} == {(1, "a b\nc\nd"), (2, ""), (3, None), (None, "q q")}
    got = mix(docs)
    assert got.columns == [*docs.columns, "mix"]
    assert Counter(tuple(r)[:-1] for r in got.collect()) == Counter(rows)  # sources without tokens are shown once
    caps = spark.createDataFrame([("http://b.com", 3, 1, 2, 3, 4)], "url string, fetched int, _n int, _url int, _key int, key int")
    got = url_filter(caps, spark.createDataFrame([("b.com", "add", 2)], "key string, action string, since int")).collect()
    assert [(*tuple(r)[:6], r["url_filter"]["blocked"]) for r in got] == [("http://b.com", 3, 1, 2, 3, 4, True)]
