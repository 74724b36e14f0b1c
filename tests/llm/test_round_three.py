"""Whitening, the field over lines and the filter audit: against brute force, with nulls, ties, repeats and empty tables."""

import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyfold.llm import filter_audit, line_crf, whitening

DATA = "/root/testdata/sf0.01"


# --- whitening


def spectrum(rng, values):
    """A symmetric matrix with these eigenvalues, made in extended precision."""
    d = len(values)
    q = np.linalg.qr(rng.standard_normal((d, d)))[0].astype(np.longdouble)
    for _ in range(4):
        q = q @ (3 * np.eye(d, dtype=np.longdouble) - q.T @ q) / 2
    return (q * np.array(values, np.longdouble)) @ q.T, q


@pytest.mark.parametrize(
    "values",
    [
        [9.0, 7.0, 4.0, 1.0, 0.5, 0.1],
        [1 + 1e-9, 1.0, 1 - 3e-9, 0.5, 0.5 - 1e-10, 1e-6],
        [5.0, 3.0, 3.0, 3.0, 1e-3, 0.0],
        list(np.linspace(1, 1 + 1e-7, 12)) + [0.2] * 3 + [1e-9],
    ],
)
def test_eigenvectors_of_clustered_eigenvalues(values):
    a, q = spectrum(np.random.default_rng(5), values)
    e, x = whitening.eigenvectors(a.astype(np.float64))
    exact = np.sort(np.array(values))[::-1]
    assert np.abs(e - exact).max() < 4e-16 * len(values) * exact[0]
    x = x.astype(np.longdouble)
    assert np.abs(x.T @ x - np.eye(len(x))).max() < 1e-15
    assert np.abs(a @ x - x * exact.astype(np.longdouble)).max() < 1e-14 * exact[0]


def test_eigenvectors_are_better_than_those_of_float32():
    a, q = spectrum(np.random.default_rng(7), [3.0, 2.9999, 2.0, 1.0])
    x = whitening.eigenvectors(a.astype(np.float64))[1]
    assert np.abs(np.abs(np.sum(x * q, 0)) - 1).max() < 1e-14 and np.abs(np.abs(x) - np.abs(q)).max() < 1e-10


def brute_whitening(vectors, k=4):
    x = np.floor(256 * np.array(vectors, float))
    u = np.unique(x, axis=0)
    c = u - u.mean(0)
    e, v = np.linalg.eigh(c.T @ c / len(u))
    e, v = e[::-1], v[:, ::-1]
    return len(u), x, u.sum(0), (x - u.mean(0)) @ v[:, :k] / np.sqrt(e[:k]), e[:k] / e.sum()


def test_whitening_against_brute_force(spark):
    rng = np.random.default_rng(1)
    vectors = (rng.standard_normal((300, 6)) * [3, 2, 1.5, 1, 0.5, 0.2] + rng.standard_normal(6)).tolist()
    rows = [(i, v) for i, v in enumerate(vectors)] + [(i, vectors[0]) for i in range(1000, 1100)] + [(3, vectors[5]), (None, vectors[6])]
    odd = [(400, None), (401, []), (402, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (403, [float("nan")] * 6), (404, [float("inf")] * 6), (405, [1.0, 2.0])]
    df = spark.createDataFrame([(i, v, 7) for i, v in rows + odd], "vec_id long, embedding array<double>, n int")
    got = whitening.whiten(df).orderBy("vec_id", "component").collect()
    n, x, sums, white, explained = brute_whitening([v for _, v in rows])
    assert len(got) == 4 * len(rows) and {r.n for r in got} == {n} == {300}
    by = {(r.vec_id, r.component): r for r in got}
    sign = {}
    for (i, _), xi, zi in zip(rows[:400], x, white):
        for k in range(4):
            r = by[i, k + 1]
            if i == 3:
                continue
            sign.setdefault(k, np.sign(r.whitened * zi[k]))
            assert r.whitened == pytest.approx(sign[k] * zi[k], abs=1e-9) and r.explained == pytest.approx(explained[k], rel=1e-12)
            assert r.deviation == int(((n * xi - sums) ** 2).sum())
    assert max(r.identity_error for r in got) < 1e-9
    assert sum(r.vec_id is None for r in got) == 4 and sum(r.vec_id == 3 for r in got) == 8


def test_whitening_of_few_and_huge_vectors(spark):
    make = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert whitening.whiten(make([])).count() == 0
    one = whitening.whiten(make([(1, [1.0, 2.0])])).collect()
    assert len(one) == 2 and all(r.n == 1 and r.deviation == 0 and r.whitened is None and r.explained is None and r.identity_error is None for r in one)
    line = whitening.whiten(make([(k, [float(k), 2.0 * k, 5.0]) for k in range(5)])).collect()
    assert [round(r.explained, 9) for r in line if r.vec_id == 0] == [1, 0, 0] and all((r.whitened is None) == (r.component > 1) for r in line)
    huge = whitening.whiten(make([(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [0.0, 3.0])])).collect()
    assert all(r.deviation is None for r in huge if r.vec_id < 3) and all(r.deviation > 0 for r in huge if r.vec_id == 3) and huge[0].identity_error < 1e-6


def test_covariance_is_exact_whatever_the_partitions(spark):
    rng = random.Random(2)
    df = spark.createDataFrame([([rng.randrange(10**6, 10**6 + 50), rng.randrange(-9, 9)],) for _ in range(500)], "x array<long>").distinct()
    a, b = whitening.covariance(df.repartition(7)), whitening.covariance(df.coalesce(1))
    assert a[0] == b[0] and a[1] == b[1] and (a[2] == b[2]).all()


# --- the field over lines


def brute_field(scores, model):
    """P(good) by line and the log of the sum over all labels, from all labels."""
    n = len(scores)
    total, good = 0.0, np.zeros(n)
    for labels in itertools.product((0, 1), repeat=n):
        w = model.start[labels[0]] + sum(model.pairs[a, b] for a, b in zip(labels, labels[1:])) + sum(s for s, k in zip(scores, labels) if k)
        total += np.exp(w)
        good += np.exp(w) * np.array(labels)
    return good / total, np.log(total)


def test_marginals_equal_sums_over_all_labels():
    rng = np.random.default_rng(3)
    model = line_crf.Model(np.zeros(1), rng.standard_normal((2, 2)), rng.standard_normal(2))
    counts = np.array([3, 1, 6, 1, 4])
    scores = rng.standard_normal(counts.sum()) * 2
    order = line_crf.chain(counts)
    p, _, first, total = line_crf.marginals(scores, order, model)
    ends = np.cumsum(counts)
    logs = []
    for a, b in zip(ends - counts, ends):
        want, log_sum = brute_field(scores[a:b], model)
        assert p[a:b] == pytest.approx(want, abs=1e-12)
        logs.append(log_sum)
    assert sorted(total) == pytest.approx(sorted(logs), abs=1e-12)
    assert first[1] == pytest.approx(p[ends - counts].sum())
    assert line_crf.marginals(np.array([900.0, -900.0, 0.0]), line_crf.chain(np.array([3])), model)[0][0] == pytest.approx(1)


def test_gradient_of_the_field():
    rng = np.random.default_rng(4)
    texts = ["ab cd. ef\n&&& ### x\n\nab", "one", "A! A! A!\nA! A! A!", ""]
    lines = line_crf.lines_of(texts)
    index, order, good = line_crf.indices(lines), line_crf.chain(lines.counts), np.array([1, 0, 0, 1])
    at = line_crf.Model(rng.standard_normal(3 * line_crf.KINDS * line_crf.CODES) / 3, rng.standard_normal((2, 2)), rng.standard_normal(2))
    _, g = line_crf.objective(at, index, lines.counts, order, good)
    for part, places in ((0, [(i,) for i in set(index[:3].ravel().tolist())][:12]), (1, list(np.ndindex(2, 2))), (2, [(0,), (1,)])):
        for place in places:
            ends = []
            for step in (1e-5, -1e-5):
                moved = [x.copy() for x in at]
                moved[part][place] += step
                ends.append(line_crf.objective(line_crf.Model(*moved), index, lines.counts, order, good)[0])
            assert g[part][place] == pytest.approx((ends[0] - ends[1]) / 2e-5, abs=1e-7)


def test_scores_do_not_depend_on_other_texts():
    rng = random.Random(1)
    model = line_crf.Model(np.array([rng.gauss(0, 1) for _ in range(3 * line_crf.KINDS * line_crf.CODES)]), np.array([[1.0, -1], [-1, 1]]), np.zeros(2))
    texts = ["\n".join("x" * rng.randrange(9) for _ in range(rng.randrange(30))) for _ in range(40)]
    assert line_crf.scores(texts, model) == pytest.approx([float(line_crf.scores([t], model)[0]) for t in texts], abs=1e-12)
    assert (line_crf.lines_of(["a b\r\nc", "é"]).counts == [2, 1]).all()


def test_quality_of_held_out_documents(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = line_crf.train(docs, labels)
    held = line_crf.score_column(docs, model).where(line_crf.held_out(F.col("doc_id"))).join(labels, "doc_id").select("quality", "quality_score").toPandas()
    right = (held["quality_score"] >= line_crf.ACCEPT) == (held["quality"] == 1)
    assert len(held) > 500 and right.mean() > 0.98
    assert right[held["quality"] == 0].mean() > 0.95


def test_quality_of_odd_rows(spark):
    rows = [(i, "clean text here.\nAnd more of it." if i % 2 else "&&& ### $$$\n&&& ***", 1, "x") for i in range(40)] + [(None, None, 1, "y"), (41, "", 2, "z"), (41, "x\n" * 5000, 2, "z"), (1, "clean text here.\nAnd more of it.", 3, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n int, quality_score string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(None, 1), (5, None), (7, 0)], "doc_id long, quality int")
    model = line_crf.train(docs, labels)
    got = line_crf.score_column(docs, model)
    assert set(got.columns) == set(docs.columns)
    got = got.collect()
    assert len(got) == len(rows) and all(0 <= r.quality_score <= 1 for r in got)
    assert all((r.quality_score > 0.5) == (r.doc_id % 2 == 1) for r in got if r.doc_id is not None and r.doc_id < 40)
    assert len({r.quality_score for r in got if r.doc_id == 1}) == 1
    only = line_crf.train(docs, labels.where("quality = 1"))
    assert {round(r.quality_score, 3) for r in line_crf.score_column(docs, only).collect()} == {1.0}
    assert line_crf.score_column(docs.limit(0), line_crf.train(docs.limit(0), labels)).count() == 0
    assert [r.h for r in docs.where("doc_id is null").select(line_crf.held_out(F.col("doc_id")).alias("h")).collect()] == [False]


# --- the filter audit


def brute_audit(docs, labels):
    """The rows of the audit from the definition, a document at a time."""
    least = {}
    for i, _, t in docs:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    failing = []
    for i, source, text in docs:
        t = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = "A" * (len(words) < 200) + "B" * (100 * len(set(words)) < 50 * len(words)) + "C" * (100 * len(re.findall("[A-Z]", t)) > 2 * len(t)) + "D" * bool(re.search(r"[#$%&*|]", t))
        fails += "E" * (i is not None and i > least[t])
        failing.append((source or "", fails, i in good, i in toxic))
    out = {}
    for part in {f[0] for f in failing}:
        own = [f for f in failing if f[0] == part]
        removed_of = dict.fromkeys("ABCDE", 0)
        for order in map("".join, itertools.permutations("ABCDE")):
            left = own
            for step, letter in enumerate(order, 1):
                here = [f for f in left if letter in f[1]]
                fail = sum(letter in f[1] for f in own)
                left = [f for f in left if letter not in f[1]]
                removed_of[letter] += len(here)
                out[part, order, step] = [len(left), len(here), fail - len(here), sum(f[1] == letter for f in own), sum(f[2] for f in here), sum(f[3] for f in here)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(removed_of[order[step - 1]])
    return out


def audit_rows(df):
    return {(r.part, r.filter_order, r.step): [r[c] for c in filter_audit.COUNTS] for r in df.collect()}


def test_audit_against_brute_force(spark):
    rng = random.Random(6)
    pool = [" ".join(rng.choice(["ab", "Cd", "e#", "fg", f"w{rng.randrange(400)}", "é"]) for _ in range(rng.choice([0, 3, 150, 220, 300]))) for _ in range(25)]
    docs = [(rng.choice([i, i, i, None, 5]), rng.choice(["s", "t", None, "", "hot", "hot"]), rng.choice([*pool, pool[0], pool[0], None, "  \t\n", "A\xa0B C"])) for i in range(300)]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 300, 2)] + [(4, 1, 0), (None, 1, 1)]
    df = spark.createDataFrame([(*d, 1, 2) for d in docs], "doc_id long, source string, text string, part int, mask int")
    got = audit_rows(filter_audit.audit(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")))
    assert got == brute_audit(docs, labels)
    assert filter_audit.audit(df.limit(0), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).count() == 0


def test_fields_do_not_run_over():
    for n in (1, 2, 3, 255, 256, 2**40 - 1):
        width = n.bit_length()
        for mask in (0, 5, 31):
            got = filter_audit.unpacked(filter_audit.packed(mask, width) * n, width, filter_audit.STEPS)
            assert got == [n * hit for hit in filter_audit.removals(mask)]


def test_audit_of_very_long_texts(spark):
    rows = [(1, "s", "word " * 300_000), (2, "s", "X" * 2_000_000)]
    got = audit_rows(filter_audit.audit(spark.createDataFrame(rows, "doc_id long, source string, text string"), spark.createDataFrame([], "doc_id long, quality int, toxic int")))
    assert got == brute_audit(rows, [])
