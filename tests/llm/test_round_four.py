"""Weights of near-duplicate search where a group of copies holds many of the documents."""

import random

import numpy as np

from tallyfold.llm import weighted_minhash


def words(rng, n):
    return [f"w{rng.randrange(5000)}" for _ in range(n)]


def jaccard(a, b):
    grams = [{tuple(x[k : k + 5]) for k in range(len(x) - 4)} for x in (a, b)]
    return len(grams[0] & grams[1]) / len(grams[0] | grams[1])


def test_copies_of_a_large_group_stay_together(spark):
    """What a fifth of the documents share as copies of one text weighs as much as their edits."""
    rng = random.Random(4)
    original = words(rng, 150)
    rows, near = [(k, words(rng, 60)) for k in range(800)], set()
    for k in range(1000, 1200):
        edited = list(original)
        for at in rng.sample(range(150), rng.randint(1, 4)):
            edited[at] = f"e{k}x{at}"
        rows.append((k, edited))
        if jaccard(original, edited) >= 0.84:
            near.add(k)
    df = spark.createDataFrame([(k, " ".join(x)) for k, x in [*rows, (5000, original)]], "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in weighted_minhash.classes(df).collect()}
    assert len(near) > 100 and min(jaccard(original, rows[k - 200][1]) for k in near) < 0.87
    assert {got[k] for k in near} == {got[5000]}
    assert all(got[k] == k for k in range(800))


def test_common_lines_keep_their_low_weight(spark):
    """A line of unrelated texts is no group of copies; a document of a small group counts whole."""
    rng = random.Random(5)
    line = "all of these have this one line in common with many others".split()
    rows = [words(rng, 100) + (line if k % 3 == 0 else []) for k in range(900)]
    table = weighted_minhash.idf_table(spark.createDataFrame([(" ".join(x),) for x in [*rows, rows[1]]], "text string"))
    low = table.of(weighted_minhash.shingles([" ".join(line)])[1])
    assert np.allclose(low, np.log1p(902 / 301), rtol=0.05)
    twice = table.of(weighted_minhash.shingles([" ".join(rows[1])])[1])
    assert np.allclose(twice, np.log1p(902 / 3))
