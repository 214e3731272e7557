"""Long single lines against brute force, and in the pipeline's stage."""

import random

import pytest

import corpus_pipeline
from loam.llm.line_dedup import line_dedup


@pytest.mark.parametrize("least", [1, 2, 3])
def test_long_lines_are_runs(spark, least):
    rng = random.Random(4)
    line = lambda n: "  ".join(rng.choice("abcdefgh") * 3 for _ in range(n))
    shared = [line(n) for n in (3, 3, 49, 50, 51, 80)]
    rows = [(i, "\n".join(x for _ in range(4) for x in (line(9), rng.choice(shared), *rng.choices(shared[:2], k=rng.randrange(3))))) for i in range(30)]
    rows += [(30, None), (31, " " + " ".join("x" * 120) + "\t\n" + " ".join("x" * 49)), (None, shared[4])]
    seen, want = set(), set()
    for i, t in sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0)):
        lines, gone = (t or "").split("\n"), set()
        for p in range(len(lines)):
            for n in {least, 1} if len(lines[p].split()) >= 50 else {least}:
                w = tuple(lines[p : p + n])
                if len(w) == n:
                    gone |= set(range(p, p + n)) if w in seen else set()
                    seen.add(w)
        want.add((i, len(gone), "\n".join(x for p, x in enumerate(lines) if p not in gone)))
    got = line_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), min_lines=least, long_words=50).collect()
    assert {(r["doc_id"], r["line_dedup"]["n_removed"], r["text"] or "") for r in got} == want


def test_lines_stage_takes_a_long_line(spark):
    passage = " ".join(f"word{i}" for i in range(60))
    docs = spark.createDataFrame([(1, f"a b\n{passage}\nc d", 1), (2, f"e f\n{passage}\ng h", 1)], "doc_id long, text string, n_chars long")
    assert {tuple(r) for r in corpus_pipeline.lines(spark, docs, "").collect()} == {(1, f"a b\n{passage}\nc d", 1), (2, "e f\ng h", 7)}
