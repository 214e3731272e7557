"""Encoding of words that no recursion reaches in time, and the columns of the query."""

import hashlib
import random
import time

import public_tokenizers
import pytest
import tiktoken

from loam.llm.bpe import LONG, MEAN, Cache, Coder, encode, gather, read_ranks, worker_cache
from loam.llm.queries import VOCABULARY, op5_bpe

PATH = public_tokenizers.path(VOCABULARY)


@pytest.fixture(scope="module")
def tik():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(PATH), special_tokens={})


def test_long_words(spark, tik):
    rng = random.Random(6)
    letters = lambda n, of: "".join(rng.choice(of) for _ in range(n))
    texts = ["a" * 1_000_000, letters(1_000_000, "abcdefghijklmnopqrstuvwxyz"), letters(LONG, "ab") + " " + letters(LONG + 1, "ab"), "é" * 700, " " * 900 + "x", "-=" * 500, "7" * 600]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    began = time.time()
    got = {r["doc_id"]: (list(r["ids"]), bytes(r["decoded"]).decode()) for r in encode(docs, PATH, decoded=True).collect()}
    assert time.time() - began < 120
    assert got == {i: (tik.encode_ordinary(t), t) for i, t in enumerate(texts)}


def test_heap_and_recursion_agree(tik):
    import pyarrow as pa

    coder, rng = Coder(read_ranks(PATH)), random.Random(1)
    words = list({bytes(rng.choice(b"aeinst the\xc3\xa9") for _ in range(rng.randrange(1, 60))) for _ in range(300)})
    ids, off = coder.encode_words(pa.array(words, pa.binary()))
    for i, w in enumerate(words):
        got = list(ids[off[i] : off[i + 1]])
        assert got == ([coder.ranks[w]] if w in coder.ranks else list(coder.contracted(w)))


def looked_up(cache, words):
    """(ids, bytes) of each word, and how many words had to be encoded."""
    import pyarrow as pa

    new, encode_words = [], cache.coder.encode_words
    cache.coder.encode_words = lambda w: new.extend(w.to_pylist()) or encode_words(w)
    try:
        at = cache.look_up(pa.array(words, pa.binary()))
    finally:
        cache.coder.encode_words = encode_words
    parts = []
    for flat, off in ((cache.ids, cache.ids_off), (cache.text, cache.text_off)):
        got, ends = gather(flat, off, at)
        parts.append([got[a:b].tolist() for a, b in zip(ends[:-1], ends[1:])])
    return list(zip(parts[0], map(bytes, parts[1]))), len(new)


def test_forgetting(tik):
    """The words met last stay, whatever comes between; results are the same with any limit."""
    rng = random.Random(9)
    hot = [b" zq%dkx" % i for i in range(20)]
    for remember in (0, 1, 2, 60, 100_000):
        cache = Cache(Coder(read_ranks(PATH)), remember)
        for turn in range(12):
            words = hot + list({b" " + bytes(rng.choice(b"aeinorst") for _ in range(9)) + b"%d" % turn for _ in range(15)})
            got, encoded = looked_up(cache, words)
            assert got == [(tik._core_bpe.encode_single_piece(w), w) for w in words]
            assert len(cache.number) == len(cache.met) == len(cache.ids_off) - 1 <= max(remember, 0) + len(words)
            if remember >= 60 and turn:
                assert encoded <= 15
    cache = Cache(Coder(read_ranks(PATH)), 10)
    looked_up(cache, [b"x" * (11 * MEAN)])
    assert looked_up(cache, [b"ab zq"])[0][0][1] == b"ab zq" and len(cache.number) == 1


def test_partitions_share_words():
    """A worker's second partition encodes only what is new to it."""
    ranks = read_ranks(PATH)
    assert looked_up(worker_cache(-1, ranks, 1000), [b" zqikx", b" qqvvy"])[1] == 2
    assert looked_up(worker_cache(-1, ranks, 1000), [b" qqvvy", b" zqikx", b" xxkky"])[1] == 1
    assert looked_up(worker_cache(-1, ranks, 7), [b" qqvvy"])[1] == 1
    assert looked_up(worker_cache(-2, ranks, 7), [b" qqvvy"])[1] == 1


def test_query_columns(spark, tik, tmp_path):
    texts = ["Hello world, it's 42!", None, "", "  spaced\n\nout \t", "naïve été don't", "Hello world, it's 42!"]
    spark.createDataFrame([(i // 2, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(2).write.parquet(f"{tmp_path}/documents.parquet")
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = sorted((i // 2, len(k := tik.encode_ordinary(t or "")), sha(",".join(map(str, k))), sha(t or "")) for i, t in enumerate(texts))
    assert sorted(tuple(r) for r in op5_bpe(spark, str(tmp_path)).collect()) == want
