"""Duplicates, search, mixing and archives: against brute force, with nulls, ties, repeats and empty tables."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyfold.llm import collision_search, imatch, merge_dropout, mixture, repeat_spans, warc, weighted_minhash


def text(rng, n, words=400):
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


def test_fingerprints(spark):
    rng = random.Random(3)
    texts = [text(rng, rng.randint(0, 80)) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(100, texts[5]), (101, None), (102, ""), (7, texts[7]), (None, "é" * 10)]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, bucket int")
    got = imatch.fingerprints(df).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, r)
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert by[5].fingerprint == by[100].fingerprint and by[101].fingerprint == by[102].fingerprint
    order = sorted((x for x in rows if x[0] is not None and x != (7, texts[7])), reverse=True)
    at = {i: k for k, (i, _) in enumerate(order)}
    for i in (0, 30, 59, 100):
        own, nxt = dict(order)[i] or "", (order[at[i] + 1][1] or "") if at[i] + 1 < len(order) else "é" * 10
        m = len(own) // 3
        assert by[i].edited_sha256 == hashlib.sha256((own[: len(own) - m] + nxt[:m]).encode()).hexdigest(), i
    assert imatch.fingerprints(df.limit(0)).count() == 0 and imatch.fingerprints(df.limit(1)).count() == 1


def brute_prints(texts, low, high):
    """Hashes of the sorted terms by subset of each text, from the definition."""
    words = [sorted(set(re.findall(r"[^\W_]+", t.lower()))) for t in texts]
    copies = collections.Counter(texts)
    heavy = max(2, imatch.HEAVY * high * len(texts))
    df, rows = collections.Counter(), collections.Counter()
    for t, w in zip(texts, words):
        rows.update(w)
        for x in w:
            df[x] += 1 / copies[t] if copies[t] >= heavy else 1
    return words, {x for x in df if rows[x] >= 2 and low * len(texts) - 1e-9 <= df[x] <= max(2, high * len(texts)) + 1e-9}


def test_fingerprints_against_the_definition(spark):
    rng = random.Random(11)
    hot = text(rng, 120, 3000)
    texts = [text(rng, rng.randint(1, 90)) for _ in range(120)] + [hot] * 40
    for k in range(40):
        w = hot.split()
        w[rng.randrange(len(w))] = f"edit{k}"
        texts.append(" ".join(w))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in imatch.fingerprints(df, 1 / 50, 1 / 10).collect()}
    words, band = brute_prints(texts, 1 / 50, 1 / 10)
    assert {r.term for r in imatch.lexicon(df, 1 / 50, 1 / 10).collect()} == band
    hashes = {r.term: r.h for r in spark.createDataFrame([(x,) for x in set().union(*words)], "term string").select("term", F.shiftrightunsigned(F.xxhash64(F.lit(imatch.SEED), "term"), 9).alias("h")).collect()}

    def known_by(w):
        own = [x for x in w if x in band]
        return own if len(own) * imatch.NEED >= len(w) else w

    def parts(w):
        by = collections.defaultdict(list)
        for x in known_by(w):
            by[hashes[x] % 96].append(x)
            by[96 + (hashes[x] >> 8) % 96].append(x)
        return [tuple(by[k]) for k in range(imatch.SUBSETS)]

    # what is not of the band counts only where there is too little of it
    assert 20 < sum(known_by(w) is not w for w in words) < len(words)

    def like(a, b):
        pairs = [(x, y) for x, y in zip(parts(a), parts(b)) if x or y]
        return sum(x == y for x, y in pairs) / len(pairs)

    for i in range(1, len(texts)):
        assert abs(got[i].near_next - like(words[i], words[i - 1])) < 1e-9, i
        m = len(texts[i]) // 3
        edited = texts[i][: len(texts[i]) - m] + texts[i - 1][:m]
        new = sorted(set(re.findall(r"[^\W_]+", edited.lower())))
        if all(x in hashes for x in new):
            assert abs(got[i].near_edited - like(words[i], new)) < 1e-9, i
    # a third of all rows are near copies: they are alike, though all their terms are over the band
    assert np.mean([got[i].near_next for i in range(161, 200)]) > 0.9 and np.mean([got[i].near_next for i in range(1, 120)]) < 0.3


def test_fingerprints_of_hot_and_null_ids(spark, monkeypatch):
    monkeypatch.setattr(imatch, "BUCKET_ROWS", 20)
    rng = random.Random(12)
    rows = [(7, text(rng, 12)) for _ in range(120)] + [(None, text(rng, 12)) for _ in range(120)] + [(k, text(rng, 12)) for k in range(-50, 60)] + [(-(1 << 63), "least id")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert imatch.bucketed(df).groupBy("bucket").count().agg(F.max("count")).first()[0] < 60
    got = imatch.neighbours(df).orderBy("bucket", "at").collect()
    assert [r.doc_id for r in got] == sorted((i for i, _ in rows), key=lambda i: (i is None, -(i or 0)))
    assert all(a.next_text == b.text for a, b in zip(got, [*got[1:], got[0]]))
    long = spark.createDataFrame([(1, "one two " * 100_000), (2, "x")], "doc_id long, text string")
    assert imatch.fingerprints(long).count() == 2


def brute_repeats(docs):
    first = {}
    for i, t in docs:
        for s in range(len(t) - 49):
            first[t[s : s + 50]] = min(first.get(t[s : s + 50], i), i)
    out = []
    for i, t in docs:
        gone = bytearray(len(t))
        for s in range(len(t) - 49):
            if first[t[s : s + 50]] < i:
                gone[s : s + 50] = b"\1" * 50
        runs = sum(1 for k in range(len(t)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((i, len(t), sum(gone), runs, bytes(b for b, c in zip(t, gone) if not c)))
    return sorted(out)


@pytest.mark.parametrize(("seed", "sorted_bytes"), [(1, 1 << 20), (2, 300)])
def test_repeats_equal_brute_force(spark, seed, sorted_bytes, monkeypatch):
    """Keys with more windows than are sorted in one go are taken in parts."""
    monkeypatch.setattr(repeat_spans, "HELD_FINDINGS", 50)
    monkeypatch.setattr(repeat_spans, "SORT_BYTES", sorted_bytes)
    rng = random.Random(seed)
    words = ["alpha", "beta", "of", "the", "é", "gamma", "a"]
    line = lambda n: " ".join(rng.choice(words) for _ in range(n))
    parts = [line(20) for _ in range(6)]
    docs = [(rng.randint(0, 30), " ".join([line(rng.randint(0, 15))] + [rng.choice(parts)[rng.randint(0, 9) :] for _ in range(rng.randint(0, 3))] + [line(5)])) for _ in range(50)]
    docs += docs[:3] + [(99, ""), (98, "x" * 300), (97, "x" * 200)]
    df = spark.createDataFrame([(i, t, 0) for i, t in docs], "doc_id long, text string, kind int").repartition(3)
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in repeat_spans.strip_repeats(df).collect())
    assert got == brute_repeats([(i, t.encode()) for i, t in docs])


def test_windows_of_a_hot_key_in_parts(monkeypatch):
    """Windows with a common middle: the parts find what one sort finds."""
    rng = np.random.default_rng(8)
    middle = rng.integers(97, 100, 44)
    windows = [np.concatenate([rng.integers(97, 99, 4), middle, rng.integers(97, 99, int(rng.integers(4, 12)))]).astype(np.uint8) for _ in range(300)]
    body, n = np.concatenate(windows), np.array([len(w) for w in windows])
    ids = rng.integers(0, 200, len(n))
    key = np.zeros(len(n), np.uint64)
    whole = repeat_spans._spans(key, ids, body, n)
    monkeypatch.setattr(repeat_spans, "SORT_BYTES", 2000)
    assert len(whole) > 50 and np.array_equal(whole, repeat_spans._spans(key, ids, body, n))


def test_repeats_of_odd_rows(spark):
    df = spark.createDataFrame([(None, "x" * 100), (1, None), (2, "x" * 100)], "doc_id long, text string")
    got = {r.doc_id: r.n_removed for r in repeat_spans.strip_repeats(df).collect()}
    assert got == {None: 0, 1: 0, 2: 0}
    assert repeat_spans.strip_repeats(df.limit(0)).count() == 0


def test_search_against_brute_force(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((1500, 24))
    x[5] = x[3]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(2000, None), (2001, [0.0] * 24), (2002, [float("nan")] * 24), (2003, [None] * 24), (2020, [1.0, 2.0]), (None, [1.0] * 24), (2040, [float("inf")] * 24)]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, block int")
    got = collections.defaultdict(list)
    for r in collision_search.search(df, k=20, query_every=50).collect():
        got[r.query_id].append(r)
    assert set(got) == set(range(0, 1500, 50))
    hit = 0
    for q, found in got.items():
        score = x @ x[q]
        best = [i for i in np.lexsort((np.arange(1500), -score)) if i != q][:20]
        hit += len(set(best) & {r.vec_id for r in found})
        found.sort(key=lambda r: r.rank)
        assert [r.rank for r in found] == list(range(1, 21)) and all(abs(score[r.vec_id] - r.score) < 1e-9 for r in found)
        assert all((-a.score, a.vec_id) <= (-b.score, b.vec_id) for a, b in zip(found, found[1:]))
    assert hit >= 0.9 * 20 * len(got)
    few = collision_search.search(df.where("vec_id < 8"), k=20, query_every=50)
    assert few.count() == 7 and collision_search.search(df.limit(0)).count() == 0


def test_search_of_repeated_ids(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [1.0, 0.1]), (2, [0.1, 1.0]), (3, [1.0, 0.1])], "vec_id long, embedding array<double>")
    got = sorted((r.query_id, r.rank, r.vec_id, round(r.score, 3)) for r in collision_search.search(df, k=2, query_every=5).collect())
    assert got == [(0, 1, 1, 1.0), (0, 1, 2, 1.0), (0, 2, 1, 0.1), (0, 2, 3, 1.0)]


@pytest.mark.parametrize("norms", ["log-normal", "one outlier"])
def test_recall_with_uneven_norms(norms):
    rng = np.random.default_rng(7)
    x = rng.standard_normal((6000, 32))
    x *= (rng.lognormal(0, 0.7, 6000) if norms == "log-normal" else np.where(np.arange(6000) == 17, 1000, 1))[:, None]
    size = np.sqrt((x * x).sum(1))
    level = np.clip(np.floor(2 * np.log2(size.max() / size)), 0, collision_search.LEVELS - 1)
    queries = np.arange(0, 6000, 60)
    best: dict[int, list] = collections.defaultdict(list)
    for at in np.unique(level):
        block = np.flatnonzero(level == at)
        for j, i, score in zip(*collision_search.nearest(x[queries], queries, x[block], block, block, 20, float(size[block].max()))):
            best[int(j)].append((-score, block[i]))
    hit = 0
    for j, q in enumerate(queries):
        score = x @ x[q]
        want = [i for i in np.lexsort((np.arange(6000), -score)) if i != q][:20]
        hit += len(set(want) & {i for _, i in sorted(best[j])[:20]})
    assert hit >= 0.9 * 20 * len(queries)


def test_near_duplicates_against_brute_force(spark):
    rng = random.Random(6)
    base = [text(rng, 120, 5000).split() for _ in range(12)]
    rows = []
    for i in range(90):
        w = list(rng.choice(base)) if i % 3 else text(rng, 100, 5000).split()
        for _ in range(rng.randint(0, 3) if i % 3 else 0):
            w[rng.randrange(len(w))] = "changed"
        rows.append((i, " ".join(w)))
    rows += [(200, None), (201, ""), (202, "..."), (203, "one two"), (204, "One, two"), (1, rows[1][1])]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, class_id int")
    got = {r.doc_id: r.class_id for r in weighted_minhash.classes(df).collect()}
    shingle = lambda t: collections.Counter(tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4))
    sets = {i: shingle(t) for i, t in rows if i < 90}
    for i in sets:
        for j in sets:
            if i < j:
                s = sum((sets[i] & sets[j]).values()) / sum((sets[i] | sets[j]).values())
                if s >= 0.85:
                    assert got[i] == got[j], (i, j, s)
                if s < 0.1:
                    assert got[i] != got[j]
    assert got[200] == 200 and got[201] == 201 and got[202] == 202 and got[203] == got[204] == 203
    kept = weighted_minhash.representatives(df)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {c for c in got.values()}
    assert weighted_minhash.classes(df.limit(0)).count() == 0


def test_document_frequencies(spark, monkeypatch):
    rows = ["a b c d e f", "a b c d e f", "x a b c d e", "q r s t u", None, ""]
    df = spark.createDataFrame([(t,) for t in rows], "text string").repartition(3)
    table = weighted_minhash.idf_table(df)
    by_text = [weighted_minhash.shingles([t])[1][0] for t in ("a b c d e", "b c d e f", "q r s t u")]
    assert np.allclose(table.of(np.array(by_text)), np.log1p(7 / np.array([4.0, 3.0, 2.0])))
    assert len(table.shingle) == 2 and np.allclose(table.of(np.zeros(1, np.uint64)), np.log1p(7 / 2))
    # rarer shingles weigh as those of the share at which frequencies are clipped
    monkeypatch.setattr(weighted_minhash, "CLIP", 0.5)
    assert np.allclose(weighted_minhash.idf_table(df).of(np.array(by_text)), np.log1p(7 / np.array([4.0, 4.0, 4.0])))


def linked(df):
    """Class by id, from all pairs."""
    table = weighted_minhash.idf_table(df)
    rows = sorted((r.doc_id, r.text) for r in df.collect())
    doc, s, count = weighted_minhash.shingles([t for _, t in rows])
    w = count * table.of(s)
    parts = [(s[doc == k], w[doc == k]) for k in range(len(rows))]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if label[i] != label[j] and weighted_minhash.weighted_jaccard(parts[j], parts[i]) >= weighted_minhash.SIMILAR:
                a, b = sorted((label[i], label[j]))
                label = [a if x == b else x for x in label]
    return {rows[k][0]: rows[x][0] for k, x in enumerate(label)}


def edit(rng, words, n, name):
    w = list(words)
    for k, at in enumerate(rng.sample(range(len(w)), n)):
        w[at] = f"{name}x{k}"
    return w


@pytest.mark.parametrize("originals", [1, 12])
def test_large_groups_of_near_copies_against_brute_force(spark, originals):
    """The originals have the largest ids, and edits of one are often under the limit to each other."""
    rng = random.Random(9)
    base = [f"b{k}" for k in range(400)]
    roots = [edit(rng, base, 3 if originals > 1 else 0, f"o{o}") for o in range(originals)]
    rows = [(k, " ".join(edit(rng, roots[k % originals], 2, f"e{k}"))) for k in range(300)] + [(1000 + o, " ".join(r)) for o, r in enumerate(roots)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in weighted_minhash.classes(df).collect()}
    want = linked(df)
    assert got == want and len(set(want.values())) < 150


def test_mixture(spark):
    rng = random.Random(8)
    rows = [(i, text(rng, rng.randint(0, 60)), rng.choice(["a", "a", "a", "b", "c", "é", None])) for i in range(400)] + [(3, None, "a"), (3, "x y", "a"), (None, "p q", None)]
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], "doc_id long, text string, source string, row int, n_chars string").drop("n_chars")
    plan = mixture.plan(df).collect()
    total = sum(r.size for r in plan)
    by = collections.defaultdict(list)
    for r in plan:
        assert 0 <= r.taken <= 2 * r.size
        by[r.source].append(r)
    names = sorted(k for k in by if k is not None) + [None]
    size = {k: sum(r.size for r in v) for k, v in by.items()}
    weight = {k: (3, 1, 2)[i % 3] for i, k in enumerate(names)}
    full, left = set(), 1.5 * total
    while True:
        share = {k: left * weight[k] / sum(weight[j] for j in names if j not in full) for k in names if k not in full}
        over = {k for k in share if share[k] > 2 * size[k]}
        if not over:
            break
        full |= over
        left = 1.5 * total - sum(2 * size[k] for k in full)
    for k in names:
        want = 2 * size[k] if k in full else share[k]
        assert abs(by[k][0].target - want) < 1e-6 * max(1, want) and abs(sum(r.taken for r in by[k]) - want) <= 0.02 * want + 3
    again = mixture.plan(df.repartition(5)).collect()
    assert collections.Counter((r.doc_id, r.size, r.taken) for r in again) == collections.Counter((r.doc_id, r.size, r.taken) for r in plan)
    mixed = mixture.mix(df)
    assert mixed.columns == df.columns and mixed.agg(F.sum(mixture.words(F.col("text")))).first()[0] == sum(r.taken for r in plan)
    assert mixture.plan(df.limit(0)).count() == 0 and mixture.mix(df.where("text is null")).count() == 0


def test_mixture_of_one_large_and_small_sources(spark):
    """Blocks are of about a hundred words; two sources have fewer, and one a few blocks."""
    sizes = [("big", 20_000)] * 220 + [("few", 5)] * 3 + [("one", 1)] + [("some", 90)] * 4
    df = spark.createDataFrame([(i, s, n) for i, (s, n) in enumerate(sizes)], "doc_id long, source string, n int").selectExpr("doc_id", "source", "repeat('w ', n) text")
    plan = mixture.plan(df).collect()
    took = collections.Counter()
    for r in plan:
        took[r.source] += r.taken
        assert r.source == "big" or r.taken == 2 * r.size
    assert all(abs(took[r.source] - r.target) <= 0.5 for r in plan) and took["few"] == 30 and took["one"] == 2 and took["some"] == 720


def brute_slots(blocks, golden):
    """(source, slot) of each block by the definition: points run through the cumulated blocks until all sources have theirs."""
    total, out, left = sum(blocks.values()), [], dict(blocks)
    for j in range(8 * total):
        unit, lo = min(math.floor((j + 1) * golden % 1.0 * total), total - 1), 0
        for name, n in blocks.items():
            if lo <= unit < lo + n and left[name]:
                left[name] -= 1
                out.append((name, j))
            lo += n
    return out


def test_slots_decide_what_the_mix_takes(spark, monkeypatch):
    rng = random.Random(12)
    monkeypatch.setattr(mixture, "SLOTS", 300)
    rows = [(i, text(rng, rng.randint(1, 40)), rng.choice(["a", "a", "b", "c", None])) for i in range(500)] + [(900, "one", "tiny")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    plan = mixture.plan(df).collect()
    length = max(1, round(sum({r.source: r.target for r in plan}.values()) / 300))
    blocks = {s: -(-round(t) // length) for s, t in sorted({r.source: r.target for r in plan}.items(), key=lambda x: (x[0] is None, x[0]))}
    slots = brute_slots(blocks, 0.6180339887498949)
    shares = mixture.targets(spark.createDataFrame([(r.source, r.size) for r in plan], "source string, size long"))
    got = sorted((r.slot, r.source) for r in mixture.schedule(shares).collect())
    assert [(s, j) for j, s in got] == slots
    # each run of slots holds each source within a few blocks of its share
    total = sum(blocks.values())
    seen = collections.Counter()
    for at, (name, _) in enumerate(slots[: 2 * total // 3], 1):
        seen[name] += 1
        assert all(abs(seen[k] - at * n / total) < 5 for k, n in blocks.items())
    # documents begin in the slot that takes their first word, and the mix is in that order
    for r in plan:
        if r.first is not None:
            assert r.first_slot in {j for s, j in slots if s == r.source}
    mixed = [(r.doc_id, r.source) for r in mixture.mix(df).collect()]
    want = sorted((slot, r.row, r.doc_id) for r in plan for slot in (r.first_slot, r.second_slot) if slot is not None)
    assert [m[0] for m in mixed] == [w[2] for w in want]
    order = [w[:1] + w[2:] for w in want]
    for constant in (0.0, 0.1234567):
        monkeypatch.setattr(mixture, "GOLDEN", constant)
        other = mixture.plan(df).collect()
        assert sorted((slot, r.doc_id) for r in other for slot in (r.first_slot, r.second_slot) if slot is not None) != sorted(order)
        if not constant:
            # all points fall to the first source: the others are not taken
            assert {r.source for r in other if r.taken} == {"a"}


def test_archives(spark, tmp_path):
    rows = [(1, "http://a b", "x"), (2, None, "x"), (3, "u", None), (4, "v", ""), (2, None, "x"), (None, "n", "zz"), (None, "n", "zz"), (7, "é\r\n", "日本\r\n\r\n")] + [(10 + k, "p", "same" * 50) for k in range(20)]
    df = spark.createDataFrame([(*r, "q") for r in rows], "page_id long, url string, html string, shard string")
    got = warc.archive(df).collect()
    assert len(got) == len(rows)
    assert collections.Counter((r.page_id, r.payload_bytes, r.payload_digest) for r in got) == collections.Counter((i, len((h or "").encode()), warc.base32_sha1((h or "").encode())) for i, _, h in rows)
    first = {}
    for r in got:
        if r.record_type == "response":
            assert r.payload_digest not in first and r.refers_to is None
            first[r.payload_digest] = r.page_id
    assert all(r.refers_to == first[r.payload_digest] for r in got if r.record_type == "revisit")
    assert len([r for r in warc.archive(df, min_bytes=100).collect() if r.record_type == "revisit"]) == 19
    files = [warc.write(df.repartition(n), f"file://{tmp_path}/{n}", shard_bytes=300, roll_bytes=100).select("file", "sha256").orderBy("file").collect() for n in (1, 4)]
    assert files[0] == files[1] and len(files[0]) > 3
    assert warc.archive(df.limit(0)).count() == 0


def test_shards_do_not_depend_on_the_spread_of_ids(spark, tmp_path):
    rows = [(k, "u", f"{k} " * 100) for k in range(400)]
    odd = [*rows, (10**15, "u", "far")] + [(None, "u", f"null {k} " * 50) for k in range(300)]
    counts = []
    for n, data in enumerate((rows, odd)):
        df = spark.createDataFrame(data, "page_id long, url string, html string")
        made = warc.write(df, f"file://{tmp_path}/{n}", shard_bytes=5000)
        counts.append((made.select("shard").distinct().count(), made.agg(F.max("records")).first()[0]))
        back = warc.read_back(spark, f"file://{tmp_path}/{n}")
        assert sorted((r.page_id is not None, r.page_id or 0, r.payload_digest) for r in back.collect()) == sorted((i is not None, i or 0, warc.base32_sha1(h.encode())) for i, _, h in data)
    assert counts[0][0] >= 25 and counts[1][0] >= counts[0][0] + 15 and counts[1][1] < 40


def test_pipeline_stages(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    odd = docs.limit(60).union(spark.createDataFrame([(9001, None, None, None, None), (9002, "", "en", "src0", 0), (None, "a b", "en", None, 3)], docs.schema))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, odd, folder)
        if name != "encoding":
            assert out.columns == docs.columns
        out.count()
        if name in ("toxicity", "near_dedup"):
            odd = out
    rows = corpus_pipeline.run(spark, folder)
    assert rows.count() > 100 and rows.where("n_pieces = 0").count() == 0
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), folder).count() == 0


def test_pipeline_values(spark):
    """Copies, personal data, ties, repeated rows, a clashing column and a long text go through each stage as stated."""
    pipe = pytest.importorskip("corpus_pipeline")
    stages = dict(pipe.STAGES)
    rng = random.Random(21)
    body = [text(rng, 60, 4000) for _ in range(12)]
    rows = [(i, t, "en", "a" if i % 2 else "b", len(t), "mine") for i, t in enumerate(body)]
    rows += [(50, body[3], "en", "a", 0, "mine"), (51, body[3] + " more", "en", "a", 0, "mine"), (60, None, "en", None, None, "mine"), (61, "", "en", "a", 0, "mine"), (0, body[0], "en", "b", 1, "again")]
    rows += [(70, "write to a@b.cd now", "en", "c", 19, "mine"), (71, "long words " * 30_000, "en", "c", 330_000, "mine"), (None, "no id", "en", "c", 5, "mine")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, severity string")
    clean = stages["toxicity"](spark, docs, "/root/testdata/sf0.001")
    assert clean.columns == docs.columns and clean.count() >= len(rows) - 1
    kept = stages["near_dedup"](spark, docs, "")
    ids = collections.Counter(r.doc_id for r in kept.collect())
    assert 50 not in ids and 51 not in ids and ids[0] == 2 and ids[60] == ids[61] == ids[None] == ids[3] == 1
    masked = {r.doc_id: r for r in stages["pii"](spark, kept, "").collect()}
    assert masked[70].text == "write to <email> now" and masked[70].n_chars == len(masked[70].text) and masked[60].text is None and masked[71].severity == "mine"
    mixed = stages["mixing"](spark, kept, "")
    assert mixed.columns == docs.columns
    taken = collections.Counter()
    for r in mixed.collect():
        taken[r.source] += len(r.text.split())
    plan = {r.source: (r.target, r.source_size) for r in mixture.plan(kept).collect()}
    assert None not in taken and all(abs(taken[k] - plan[k][0]) <= 0.5 for k in taken)
    coded = stages["encoding"](spark, kept, "").collect()
    texts = {(r.doc_id, r.source): r.text for r in kept.collect()}
    assert len(coded) == kept.count() and all(merge_dropout.decode(r.pieces) == (texts[r.doc_id, r.source] or "") for r in coded)
    assert len({tuple(r.pieces) for r in coded if r.doc_id == 0}) == 1
