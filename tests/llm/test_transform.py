"""The collection transform against sorted suffixes, and repeated strings at the edges of what a task reads at once."""

import gc
import random
import weakref

import numpy as np
import pyarrow as pa
import pytest

from loam.llm import suffix_dedup
from loam.llm.queries import op7_suffix_dedup
from loam.llm.suffix_dedup import NONE, CollectionTransform, remove_repeats


def common(a, b):
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    return n


@pytest.mark.parametrize("letters", [b"ab", b"abcd", b"abcdefghij"])
def test_transform_and_common_prefixes(letters):
    rng = random.Random(letters[-1])
    for _ in range(60):
        texts = [bytes(rng.choice(letters) for _ in range(rng.randrange(14))) for _ in range(rng.randrange(1, 9))]
        shift = [rng.randrange(4) for _ in texts]
        index = CollectionTransform(len(texts), piece=rng.choice((3, 7, 1 << 20)))
        for c in range(max(len(t) + k for t, k in zip(texts, shift)), -1, -1):
            index.insert(np.array([t[c - k] if 0 <= c - k < len(t) else NONE for t, k in zip(texts, shift)], np.uint8))
        suffixes = sorted((t[j:], i, j) for i, t in enumerate(texts) for j in range(len(t) + 1))
        index.transform.seek(0), index.common.seek(0)
        assert index.transform.read() == bytes(texts[i][j - 1] if j else NONE for _, i, j in suffixes)
        assert list(index.common.read()) == [0] + [common(a[0], b[0]) for a, b in zip(suffixes, suffixes[1:])]
        index.close()


def brute(rows, width=100):
    """doc_id -> (bytes, removed flags), the strings judged on the input."""
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda x: x[0]):
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - width + 1):
            if b[p : p + width] in seen:
                gone[p : p + width] = True
            seen.add(b[p : p + width])
        out[i] = b, gone
    return out


def test_query_columns(spark, tmp_path):
    import hashlib

    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(4))
    hot = " ".join(word() for _ in range(60))
    texts = [" ".join(word() for _ in range(rng.randrange(60))) + hot[: rng.randrange(len(hot))] + word() + hot[rng.randrange(len(hot)) :] for _ in range(60)]
    rows = [*enumerate(texts), (60, None), (61, ""), (62, texts[3]), (63, hot[:100]), (64, "ab" * 400)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    want = set()
    for i, (b, gone) in brute(rows).items():
        runs = int(np.count_nonzero(np.diff(np.r_[0, gone.astype(int)]) == 1))
        want.add((i, len(b), int(gone.sum()), runs, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest()))
    assert {tuple(r) for r in op7_suffix_dedup(spark, str(tmp_path)).collect()} == want


def test_long_texts_are_cut_without_loss(spark, monkeypatch):
    rng = random.Random(9)
    line = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    copied = line(700)
    rows = [(0, line(3000) + copied + line(100)), (1, line(900) + copied), (2, copied[50:400] + line(2000) + copied[300:])]
    batches = lambda: iter([__import__("pyarrow").RecordBatch.from_pylist([{"text": t} for _, t in rows])])
    whole = [(r, s, bytes(d)) for r, s, d, _ in suffix_dedup.pieces(batches(), "text", 99, 256)]
    assert len(whole) > 10 and all(len(d) <= 256 + 99 for _, _, d in whole)
    got = {r["doc_id"]: bytes(r["kept"]) for r in remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: bytes(np.frombuffer(b, np.uint8)[~gone]) for i, (b, gone) in brute(rows).items()}


def test_workers_let_go_of_the_texts(spark, monkeypatch):
    made, in_arrow = [], suffix_dedup.in_arrow
    monkeypatch.setattr(suffix_dedup, "in_arrow", lambda df, run, schema: made.append(run) or in_arrow(df, run, schema))
    remove_repeats(spark.createDataFrame([(0, "a")], "doc_id long, text string"))
    data = np.frombuffer(b"abcdefghij" * 10, np.uint8).copy()
    held = weakref.ref(data)
    texts = pa.Array.from_buffers(pa.string(), 5, [None, pa.py_buffer(np.array([0, 40, 40, 50, 70, 100], np.int32)), pa.py_buffer(data)])
    lo, hi = (pa.array(x, pa.list_(pa.int64())) for x in ([None, None, [0], [1, 15], []], [None, None, [10], [12, 20], []]))
    rows = pa.RecordBatch.from_arrays([pa.array(range(5)), texts, lo, hi], names=["doc_id", "text", "lo", "hi"])
    del data, texts
    got = [x for b in made[-1](iter([rows.slice(1), rows.slice(0, 2)])) for x in b.column(4).to_pylist()]
    assert got == [b"", b"", b"acde", b"abcdefghij" * 3, b"abcdefghij" * 4, b""]
    del rows
    gc.collect()
    assert held() is None


def test_refuses_widths_that_do_not_fit(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    for width in (27, 142):
        with pytest.raises(ValueError):
            remove_repeats(docs, width=width)
