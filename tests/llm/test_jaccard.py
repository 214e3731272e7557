"""Near copies of a similarity from 0.8 up, against brute force."""

import random

import corpus_pipeline

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def words(t):
    w = (t or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_near_copies_from_a_similarity_of_0_8(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    common, texts = " ".join(word() for _ in range(30)), ["", None, "one two", "One  two", "three"]
    for _ in range(25):
        base = [word() for _ in range(rng.randrange(60, 300))]
        texts.append(" ".join(base) + " " + common)
        for _ in range(3):  # some below the similarity, some chained through others
            near = list(base)
            for at in rng.sample(range(len(near)), rng.randrange(1, 2 + len(near) // 30)):
                near[at] = word()
            texts.append(" ".join(near) + " " + common)
            base = rng.choice((base, near))
    rng.shuffle(texts)
    rows = [(i, t, None, None, 0) for i, t in enumerate(texts)]
    rows += [rows[9], (None, texts[9], None, None, 0)]
    sets, least = [words(t) for t in texts], list(range(len(texts)))
    alike = [(a, b) for a in range(len(texts)) for b in range(a) if not sets[a] | sets[b] or len(sets[a] & sets[b]) * 5 >= 4 * len(sets[a] | sets[b])]
    assert any(0.8 <= len(sets[a] & sets[b]) / len(sets[a] | sets[b]) < 0.85 for a, b in alike if sets[a])
    for _ in texts:
        for a, b in alike:
            least[a] = least[b] = min(least[a], least[b])
    got = corpus_pipeline.near_copies(spark, spark.createDataFrame(rows, DOCUMENTS).repartition(3), "").collect()
    want = [r for r in rows if r[0] is None or least[r[0]] == r[0]]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
