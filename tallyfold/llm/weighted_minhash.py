"""Near-duplicate classes by improved consistent weighted sampling over TF-IDF shingles.

A document is the multiset of its shingles of five lower-case words; a shingle weighs its count times its inverse
document frequency. Document frequencies are those of the shingles themselves, counted over all documents in one shuffle of
packed hashes; shingles in under ``CLIP`` of the documents (1e-4) weigh as if they were in so many. So the table of frequencies that
goes to the executors holds at most (mean number of distinct shingles) / ``CLIP`` entries, whatever the number of
documents, and weights mean the same at any size. A group of copies counts as half of ``CLIP`` of the documents, or two,
if it holds more: each of its members counts as a part of a document. Else what copies share would weigh less than
their edits the more copies there are, and large groups would come apart. Groups are known by how many documents
have the same bands of a plain sketch, of which the frequent ones, ``BINS`` / ``CLIP`` at most, go to the executors too.
For each of ``BANDS * ROWS`` keys the sampler draws one
(shingle, level) pair such that two documents draw the same pair with a probability equal to their weighted
Jaccard similarity; ``ROWS`` samples make a band. Documents that share a band are candidates; texts with equal
multisets count once from here on. In each band each document is first compared to three members of its group: the
smallest id, a member chosen by a hash, and the member that meets the most others. Where that leaves a group in
several classes, all its pairs between classes are compared, in tiles of ``CHUNK`` by ``CHUNK`` texts that any task
can take; only a group whose members are candidates but not similar costs the square of its size. A candidate pair is
a link when its weighted Jaccard similarity, computed from the whole texts, reaches ``SIMILAR``. Classes are the
connected components of the links; the class id is the smallest id.

Cases: texts without words (null, empty, punctuation) are in classes of their own; texts of one to four words are
one shingle; long texts are used whole; equal texts are always in one class; rows that repeat an id count as one
document, in the class of any of its texts; an empty table gives no rows; extra columns are kept by ``representatives``.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.llm.common import expand, partitions, settle, slices, squeeze

SHINGLE, SIMILAR = 5, 0.8
BANDS, ROWS = 8, 2
CLIP = 1e-4
#: Ranges of hashes that give a sketch its numbers, two for a band, and how many of a text's bands many others must have
#: for it to count as one of their copies: as many as texts share that are about a third alike.
BINS, ALIKE = 64, 4
#: What a document counts that is in no large group of copies; whole numbers sum up alike in any order.
UNIT = 1 << 20
#: Shingles that a task counts before it sends them, and of a bucket.
CHUNK_SHINGLES = 2_000_000
#: Documents compared to one centre, or held in a tile, in one go.
CHUNK = 256
MEMO_SIZE, MEMO_WORD = 300_000, 40
_WORD = re.compile(r"\w+")
_K = [np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit hash of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * _K[1]
    x = (x ^ (x >> np.uint64(27))) * _K[2]
    return x ^ (x >> np.uint64(31))


class WordHash(dict):
    def __missing__(self, word: str) -> int:
        h = xxhash.xxh64_intdigest(word)
        if len(word) <= MEMO_WORD:
            if len(self) >= MEMO_SIZE:
                self.clear()
            self[word] = h
        return h


_words = WordHash()


def shingles(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document number, shingle, count), by document and shingle."""
    hashed, sizes = [], []
    for text in texts:
        found = _WORD.findall(text.lower()) if text else []
        hashed.append(np.fromiter(map(_words.__getitem__, found), np.uint64, len(found)))
        sizes.append(len(found))
    n = np.array(sizes, np.int64)
    w = np.concatenate(hashed) if hashed else np.zeros(0, np.uint64)
    # short texts are one shingle, as if filled up with zeros
    first = np.cumsum(n) - n
    count = np.where(n >= SHINGLE, n - SHINGLE + 1, np.minimum(n, 1))
    doc = np.repeat(np.arange(len(n)), count)
    at = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + first[doc]
    s = np.zeros(len(at), np.uint64)
    left = n[doc] - (at - first[doc])
    for k in range(SHINGLE):
        inside = left > k
        s = mix(s * _K[0] + np.where(inside, w[np.minimum(at + k, max(len(w) - 1, 0))] if len(w) else np.uint64(0), np.uint64(0)) + np.uint64(1))
    end = np.cumsum(count)
    for b, e in zip((end - count).tolist(), end.tolist()):
        s[b:e].sort()
    new = np.append(True, (doc[1:] != doc[:-1]) | (s[1:] != s[:-1])) if len(s) else np.zeros(0, bool)
    begin = np.flatnonzero(new)
    return doc[begin], s[begin], np.diff(np.append(begin, len(s)))


def _gamma_table(size: int) -> np.ndarray:
    """Quantiles of the gamma distribution with shape 2 and scale 1."""
    x = np.concatenate([np.linspace(0, 1, 4000)[1:] ** 2 * 4, np.linspace(4, 40, 4000)[1:]])
    return np.interp((np.arange(size) + 0.5) / size, 1 - (1 + x) * np.exp(-x), x)


_GAMMA = _gamma_table(1 << 16)
_LOG_GAMMA = np.log(_GAMMA)


def samples(doc: np.ndarray, shingle: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """n x (BANDS * ROWS) hashes of the sampled (shingle, level) pairs; every document number below n occurs."""
    begin = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
    log_w = np.log(weight)
    out = np.zeros((n, BANDS * ROWS), np.uint64)
    low = np.uint64(0xFFFF)
    for k in range(BANDS * ROWS):
        h = mix(shingle + np.uint64(int(_K[0]) * (k + 1) % (1 << 64)))
        r = _GAMMA[(h & low).astype(np.int64)]
        log_c = _LOG_GAMMA[((h >> np.uint64(16)) & low).astype(np.int64)]
        beta = (h >> np.uint64(32)).astype(np.float64) * 2.0**-32
        level = np.floor(log_w / r + beta)
        a = log_c - r * (level - beta + 1)
        best = np.minimum.reduceat(a, begin)
        at = np.flatnonzero(a == np.repeat(best, np.diff(np.append(begin, len(doc)))))
        at = at[np.append(True, doc[at][1:] != doc[at][:-1])]
        out[:, k] = mix(shingle[at] + level[at].astype(np.int64).astype(np.uint64) * _K[2])
    return out


#: The ranges that stand in for each range, itself first, where a text has no shingle in it.
_STAND_IN = [sorted(range(BINS), key=lambda x, k=k: (x != k, xxhash.xxh64_intdigest(f"{k} {x}"))) for k in range(BINS)]


def sketch(doc: np.ndarray, shingle: np.ndarray) -> np.ndarray:
    """A row of BINS / 2 hashes for each document that occurs; two have each alike with about the square of their Jaccard similarity."""
    number = np.cumsum(np.append(True, doc[1:] != doc[:-1])) - 1 if len(doc) else doc
    part = (shingle >> np.uint64(64 - BINS.bit_length() + 1)).astype(np.int64)
    # shingles are sorted, so the first of a range is its smallest
    at = np.flatnonzero(np.append(True, (number[1:] != number[:-1]) | (part[1:] != part[:-1]))) if len(doc) else number
    least = np.zeros((len(np.unique(number)), BINS), np.uint64)
    has = np.zeros(least.shape, bool)
    least[number[at], part[at]], has[number[at], part[at]] = shingle[at], True
    rows, out = np.arange(len(least)), np.zeros_like(least)
    for k, order in enumerate(np.array(_STAND_IN)):
        out[:, k] = mix(least[rows, order[has[:, order].argmax(axis=1)]] * _K[0] + np.uint64(k))
    return mix(out[:, 0::2] * _K[0] + out[:, 1::2])


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Of two (sorted shingles, weights)."""
    if not len(a[0]) or not len(b[0]):
        return 0.0
    at = np.minimum(np.searchsorted(a[0], b[0]), len(a[0]) - 1)
    hit = a[0][at] == b[0]
    both = np.minimum(a[1][at[hit]], b[1][hit]).sum()
    return float(both / (a[1].sum() + b[1].sum() - both))


class Idf:
    """Inverse document frequencies: of the frequent shingles each its own, of all others one."""

    def __init__(self, shingle: np.ndarray, df: np.ndarray, total: int):
        order = np.argsort(shingle)
        self.shingle, self.weight = shingle[order], np.log1p((total + 1) / (df[order] + 1.0))
        self.other = float(np.log1p((total + 1) / (max(1.0, CLIP * total) + 1.0)))

    def of(self, shingle: np.ndarray) -> np.ndarray:
        if not len(self.shingle):
            return np.full(len(shingle), self.other)
        at = np.minimum(np.searchsorted(self.shingle, shingle), len(self.shingle) - 1)
        return np.where(self.shingle[at] == shingle, self.weight[at], self.other)


def _pack(values: np.ndarray) -> bytes:
    """Whole numbers by bytes of like weight, compressed: sorted hashes take little more than their differences."""
    steps = np.diff(values, prepend=values.dtype.type(0))
    return squeeze(np.ascontiguousarray(steps.view(np.uint8).reshape(len(steps), -1).T), 1)


def _unpack(data: bytes, kind) -> np.ndarray:
    width = np.dtype(kind).itemsize
    steps = expand(data, np.uint8).reshape(width, -1).T
    return np.cumsum(np.ascontiguousarray(steps).view(kind).ravel(), dtype=kind)


class Copies:
    """What a document counts: less than ``UNIT`` in a group of more than ``most`` copies, which together count as about so many."""

    def __init__(self, band: np.ndarray, size: np.ndarray, most: float):
        order = np.argsort(band)
        self.band, self.size, self.most = band[order], size[order], most

    def amounts(self, doc: np.ndarray, shingle: np.ndarray) -> np.ndarray:
        """For each document that occurs."""
        bands = sketch(doc, shingle)
        if not len(self.band):
            return np.full(len(bands), UNIT, np.int64)
        at = np.minimum(np.searchsorted(self.band, bands), len(self.band) - 1)
        size = np.sort(np.where(self.band[at] == bands, self.size[at], 0.0), axis=1)[:, -ALIKE]
        return np.maximum(1, UNIT * self.most / np.maximum(size, self.most)).astype(np.int64)


def _send_counts(buckets: int, counted):
    """One row (bucket, items, counts) for each bucket and chunk of texts; buckets are ranges of hashes.

    ``counted`` gives the hashes of some texts and what each counts.
    """
    edges = np.array([(k << 64) // buckets for k in range(1, buckets)], np.uint64)

    def run(batches):
        held, size = [], 0

        def flush():
            s, n = (np.concatenate(x) for x in zip(*held))
            held.clear()
            whole = n == UNIT
            one, times = np.unique(s[whole], return_counts=True)
            rows = []
            for s, n in ((one, times * UNIT), _summed(s[~whole], n[~whole])):
                cut = [0, *np.searchsorted(s, edges).tolist(), len(s)]
                rows += [(k, _pack(s[b:e]), _pack(n[b:e].astype(np.uint64))) for k, (b, e) in enumerate(zip(cut, cut[1:])) if e > b]
            bucket, item, n = zip(*rows)
            return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.array(item, pa.binary()), pa.array(n, pa.binary())], ["bucket", "items", "counts"])

        for batch in slices(batches, 0):
            held.append(counted(batch.column(0).to_pylist()))
            size += len(held[-1][0])
            if size >= CHUNK_SHINGLES:
                yield flush()
                size = 0
        if size:
            yield flush()

    return run


def _summed(s: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different items, in order, and the sum of each."""
    order = np.argsort(s, kind="stable")
    s, n = s[order], n[order]
    begin = np.flatnonzero(np.append(True, s[1:] != s[:-1])) if len(s) else order
    return s[begin], np.add.reduceat(n, begin) if len(s) else n


def _frequent(least: float):
    """(item, n) of the items in ``least`` documents at least, from rows ordered by bucket."""

    def run(batches):
        at, held = None, []

        def flush():
            s, n = _summed(np.concatenate([_unpack(a, np.uint64) for a, _ in held]), np.concatenate([_unpack(b, np.uint64) for _, b in held]).astype(np.int64))
            keep = n >= least * UNIT
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(s[keep].view(np.int64)), pa.array(n[keep] / UNIT)], ["item", "n"])

        for batch in batches:
            for bucket, s, n in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if held and bucket != at:
                    yield flush()
                at = bucket
                held.append((s, n))
        if held:
            yield flush()

    return run


def _counts(docs: DataFrame, counted, buckets: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, counts) of the items of all texts that count ``least`` documents at least."""
    sent = docs.select("text").mapInArrow(_send_counts(buckets, counted), "bucket int, items binary, counts binary")
    frequent = sent.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(_frequent(least), "item long, n double").toPandas()
    return frequent["item"].to_numpy(np.int64).view(np.uint64), frequent["n"].to_numpy(np.float64)


def _bands_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    doc, s, _ = shingles(texts)
    bands = sketch(doc, s).ravel()
    return bands, np.full(len(bands), UNIT, np.int64)


def _shingles_of(copies):
    def counted(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        doc, s, _ = shingles(texts)
        return s, np.repeat(copies.value.amounts(doc, s), np.unique(doc, return_counts=True)[1])

    return counted


def idf_table(docs: DataFrame) -> Idf:
    """Document frequencies, counted over all documents, of the shingles in two of them and in ``CLIP`` of them at least.

    A larger group of copies counts as half of ``CLIP`` of the documents, or as two.
    """
    total, size = docs.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    # half, as the members that have a band alike may be half of the group
    most, fewest = max(2.0, CLIP * total / 2), partitions(docs.sparkSession)
    copies = Copies(*_counts(docs, _bands_of, max(fewest, total * BINS // 2 // CHUNK_SHINGLES), most), most)
    # words of a text are about six characters apart
    counted = _shingles_of(docs.sparkSession.sparkContext.broadcast(copies))
    return Idf(*_counts(docs, counted, max(fewest, size // 6 // CHUNK_SHINGLES), max(2.0, CLIP * total)), total)


def signatures(docs: DataFrame, idf) -> DataFrame:
    """(doc_id, key_hi, key_lo, bands); keys are equal for equal shingle multisets and null without words."""

    def run(batches):
        table = idf.value
        for batch in slices(batches, 1):
            doc, s, count = shingles(batch.column(1).to_pylist())
            n = batch.num_rows
            has = np.zeros(n, bool)
            has[doc] = True
            hi, lo, bands = np.zeros(n, np.int64), np.zeros(n, np.int64), [None] * n
            if len(doc):
                begin = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
                one = mix(s + count.astype(np.uint64) * _K[1])
                hi[has] = np.add.reduceat(one, begin).view(np.int64)
                lo[has] = np.add.reduceat(mix(one + _K[0]), begin).view(np.int64)
                number = np.cumsum(np.append(True, doc[1:] != doc[:-1])) - 1
                got = samples(number, s, count * table.of(s), len(begin))
                band = got[:, 0::ROWS].copy()
                for k in range(1, ROWS):
                    band = mix(band * _K[0] + got[:, k::ROWS])
                for i, row in zip(np.flatnonzero(has).tolist(), band.view(np.int64).tolist()):
                    bands[i] = row
            hide = lambda x: pa.array(x, pa.int64(), mask=~has)
            yield pa.RecordBatch.from_arrays([batch.column(0), hide(hi), hide(lo), pa.array(bands, pa.list_(pa.int64()))], ["doc_id", "key_hi", "key_lo", "bands"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, key_hi long, key_lo long, bands array<long>")


def grouped(first: DataFrame) -> DataFrame:
    """(doc, band, value, centres): the members of each band's groups; ``first`` has one row (doc_id, bands) per distinct text.

    The third centre is the member that meets the most others over all bands: an original among its edits.
    """
    spread = first.select(F.col("doc_id").alias("doc"), F.posexplode("bands").alias("band", "value"))
    sizes = spread.groupBy("band", "value").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = settle(spread.join(sizes.hint("shuffle_hash"), ["band", "value"]), "minhash-members")
    met = members.groupBy("doc").agg(F.sum("n").alias("met"))
    centres = members.join(met.hint("merge"), "doc").groupBy("band", "value").agg(F.min("doc").alias("least"), F.min_by("doc", F.xxhash64("doc", "band")).alias("other"), F.max_by("doc", F.struct("met", -F.col("doc"))).alias("central"))
    # written, as other tables by group below, so that adaptive execution can split the rows of a hot group
    centres = settle(centres.select("band", "value", F.array_distinct(F.array("least", "other", "central")).alias("centres")), "minhash-centres")
    return settle(members.select("doc", "band", "value").join(centres.hint("shuffle_hash"), ["band", "value"]), "minhash-groups")


def candidates(groups: DataFrame) -> DataFrame:
    """(centre, doc): each text and the centres of its groups."""
    pairs = groups.select("doc", F.explode("centres").alias("centre")).where("doc <> centre")
    return pairs.select(F.greatest("doc", "centre").alias("doc"), F.least("doc", "centre").alias("centre")).distinct()


def links(docs: DataFrame, pairs: DataFrame, idf, similar: float = SIMILAR) -> DataFrame:
    """(centre, doc, similarity) of the candidate pairs that are similar enough."""
    pairs = settle(pairs, "minhash-pairs")
    # written, so that adaptive execution can split the pairs of a hot centre
    many = settle(pairs.groupBy("centre").agg((F.count(F.lit(1)) / CHUNK + 1).cast("int").alias("chunks")), "minhash-chunks")
    rows = pairs.join(many.hint("merge"), "centre").select("centre", F.pmod(F.xxhash64("doc"), F.col("chunks")).cast("int").alias("chunk"), "doc")
    rows = rows.union(rows.select("centre", "chunk", F.col("centre").alias("doc")).distinct())
    texts = docs.select(F.col("doc_id").cast("long").alias("doc"), "text")
    full = rows.join(texts.hint("merge"), "doc")
    ordered = full.repartition(partitions(docs.sparkSession), "centre", "chunk").sortWithinPartitions("centre", "chunk", F.col("doc") != F.col("centre")).select("centre", "chunk", "doc", "text")

    def run(batches):
        table = idf.value
        at, middle = None, []
        for batch in slices(batches, 3):
            doc, s, count = shingles(batch.column(3).to_pylist())
            weight = count * table.of(s)
            ends = np.searchsorted(doc, np.arange(batch.num_rows + 1))
            out: tuple[list, list, list] = ([], [], [])
            for i, (centre, chunk, d) in enumerate(zip(*(batch.column(k).to_pylist() for k in range(3)))):
                mine = (s[ends[i] : ends[i + 1]], weight[ends[i] : ends[i + 1]])
                if (centre, chunk) != at:
                    at, middle = (centre, chunk), []
                if d == centre:
                    middle.append(mine)
                elif (best := max((weighted_jaccard(m, mine) for m in middle), default=0.0)) >= similar:
                    for column, value in zip(out, (centre, d, best)):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], ["centre", "doc", "similarity"])

    return ordered.mapInArrow(run, "centre long, doc long, similarity double")


class Held:
    """The texts of one side of a tile, by shingle."""

    def __init__(self, parts: list[tuple[np.ndarray, np.ndarray]]) -> None:
        self.n = len(parts)
        self.total = np.array([w.sum() for _, w in parts], np.float64)
        s = np.concatenate([s for s, _ in parts])
        order = np.argsort(s, kind="stable")
        self.weight = np.concatenate([w for _, w in parts])[order]
        self.owner = np.repeat(np.arange(self.n), [len(s) for s, _ in parts])[order]
        self.shingle, begin = np.unique(s[order], return_index=True)
        self.begin = np.append(begin, len(s))

    def similarity(self, part: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """The weighted Jaccard similarity of a text to each of the held."""
        s, w = part
        if not len(s) or not len(self.shingle):
            return np.zeros(self.n)
        at = np.minimum(np.searchsorted(self.shingle, s), len(self.shingle) - 1)
        hit = self.shingle[at] == s
        at, w_hit = at[hit], w[hit]
        many = self.begin[at + 1] - self.begin[at]
        where = np.repeat(self.begin[at] - np.cumsum(many) + many, many) + np.arange(int(many.sum()))
        both = np.bincount(self.owner[where], np.minimum(self.weight[where], np.repeat(w_hit, many)), self.n)
        return both / np.maximum(self.total + w.sum() - both, 1e-300)


def _root(roots: dict[int, int], x: int) -> int:
    while x in roots:
        x = roots[x]
    return x


def open_tiles(groups: DataFrame, labels: DataFrame) -> DataFrame:
    """(band, value, i, j, held, doc, label): tiles of all pairs of a group that no link joins yet and no centre settled.

    In each group the members outside its largest class are held, in blocks, against blocks of all members.
    """
    placed = groups.where(~F.array_contains("centres", F.col("doc"))).select("doc", "band", "value").join(labels.select(F.col("node").alias("doc"), "label").hint("merge"), "doc", "left")
    placed = settle(placed.withColumn("label", F.coalesce("label", "doc")), "minhash-placed")
    by_label = placed.groupBy("band", "value", "label").agg(F.count(F.lit(1)).alias("n"))
    still = by_label.groupBy("band", "value").agg(F.max_by("label", F.struct("n", "label")).alias("major"), F.sum("n").alias("n"), F.max("n").alias("most")).where("most < n")
    still = still.select("band", "value", "major", F.ceil(F.col("n") / CHUNK).cast("int").alias("blocks"), F.ceil((F.col("n") - F.col("most")) / CHUNK).cast("int").alias("rest"))
    rows = placed.join(settle(still, "minhash-still").hint("merge"), ["band", "value"])
    h = F.xxhash64("doc")
    side = lambda held, own, mine, other, count: rows.select(
        "band", "value", F.pmod(h, F.col(mine)).cast("int").alias(own), F.explode(F.sequence(F.lit(0), F.col(count) - 1)).alias(other), F.lit(held).alias("held"), "doc", "label", "major"
    )
    held = side(True, "i", "rest", "j", "blocks").where("label <> major")
    streamed = side(False, "j", "blocks", "i", "rest").select(*held.columns)
    return held.unionByName(streamed).drop("major")


def rest_links(docs: DataFrame, tiles: DataFrame, idf, similar: float = SIMILAR) -> DataFrame:
    """(centre, doc, similarity, a, b): links of the tiles between classes ``a`` and ``b``; a link that joins nothing new in its tile is left out."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc"), "text")
    key = ["band", "value", "i", "j"]
    full = settle(tiles, "minhash-tiles").join(texts.hint("merge"), "doc")
    ordered = full.repartition(partitions(docs.sparkSession), *key).sortWithinPartitions(*key, ~F.col("held"), "doc").select(*key, "held", "doc", "label", "text")

    def run(batches):
        table = idf.value
        at, held, index, roots = None, [], None, {}
        for batch in slices(batches, 7):
            doc, s, count = shingles(batch.column(7).to_pylist())
            weight = count * table.of(s)
            ends = np.searchsorted(doc, np.arange(batch.num_rows + 1))
            out: tuple[list, ...] = ([], [], [], [], [])
            for k, (*tile, is_held, d, label) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(7)))):
                mine = (s[ends[k] : ends[k + 1]], weight[ends[k] : ends[k + 1]])
                if tile != at:
                    at, held, index, roots = tile, [], None, {}
                if is_held:
                    held.append((d, label, mine))
                    continue
                if not held or all(_root(roots, x[1]) == _root(roots, label) for x in held):
                    continue
                index = index or Held([x[2] for x in held])
                near = index.similarity(mine)
                for n in np.flatnonzero(near >= similar):
                    a, b = sorted((_root(roots, held[n][1]), _root(roots, label)))
                    if a != b:
                        roots[b] = a
                        for column, value in zip(out, (min(d, held[n][0]), max(d, held[n][0]), float(near[n]), held[n][1], label)):
                            column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.float64() if c == 2 else pa.int64()) for c, x in enumerate(out)], ["centre", "doc", "similarity", "a", "b"])

    return ordered.mapInArrow(run, "centre long, doc long, similarity double, a long, b long")


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, label): the smallest node that each node of ``edges`` is connected to, by label passing and jumps."""
    both = settle(edges.select(F.col(a).alias("node"), F.col(b).alias("peer")).union(edges.select(b, a)), "components-edges")
    labels = settle(both.groupBy("node").agg(F.least("node", F.min("peer")).alias("label")), "components")
    while True:
        peers = both.join(labels.select(F.col("node").alias("peer"), F.col("label").alias("near")).hint("merge"), "peer").groupBy("node").agg(F.min("near").alias("near"))
        passed = labels.join(peers.hint("merge"), "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("to"))
        jump = labels.select(F.col("node").alias("to"), F.col("label").alias("further"))
        labels = settle(passed.join(jump.hint("merge"), "to", "left").select("node", F.least("to", F.coalesce("further", "to")).alias("label"), "old"), "components")
        if labels.where("label <> old").isEmpty():
            return labels.select("node", "label")


def classes(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """(doc_id, class_id, n_links): the near-duplicate class of each row, and the number of its text's links that were verified.

    Links between texts that are in one class already are not looked for, so ``n_links`` is a lower bound.
    """
    spark = docs.sparkSession
    idf = spark.sparkContext.broadcast(idf_table(docs))
    signed = settle(signatures(docs, idf), "minhash-signatures")
    worded = signed.where("key_hi is not null and doc_id is not null")
    first = worded.groupBy("key_hi", "key_lo").agg(F.min_by("bands", "doc_id").alias("bands"), F.min("doc_id").alias("doc_id"))
    groups = grouped(first.select("doc_id", "bands"))
    found = settle(links(docs, candidates(groups), idf, similar), "minhash-links").distinct()
    # rows that repeat an id with another text join its classes too
    owner = worded.groupBy("key_hi", "key_lo").agg(F.min("doc_id").alias("owner"))
    owner = settle(owner, "minhash-owners")
    members = settle(worded.select("doc_id", "key_hi", "key_lo").join(owner.hint("merge"), ["key_hi", "key_lo"]).select("doc_id", "owner").distinct(), "minhash-owned")
    several = members.groupBy("doc_id").agg(F.min("owner").alias("a"), F.max("owner").alias("b")).where("a <> b").select("a", "b")
    labels = components(found.select(F.col("centre").alias("a"), F.col("doc").alias("b")).union(several), "a", "b")
    # what the centres left apart is compared in full
    rest = settle(rest_links(docs, open_tiles(groups, labels), idf, similar), "minhash-rest")
    found = found.union(rest.select(*found.columns)).select("centre", "doc").distinct()
    joined = components(rest, "a", "b").select(F.col("node").alias("label"), F.col("label").alias("further"))
    degree = found.select(F.explode(F.array("centre", "doc")).alias("owner")).groupBy("owner").agg(F.count(F.lit(1)).alias("links"))
    # what is known of a text, with one row each, before it meets the rows that hold the text: those may be a hot key
    texts = labels.withColumnRenamed("node", "owner").join(joined.hint("merge"), "label", "left").withColumn("label", F.coalesce("further", "label")).drop("further")
    texts = texts.join(degree.hint("merge"), "owner", "full")
    single = joined.withColumnRenamed("label", "owner")
    texts = settle(texts.join(single.hint("merge"), "owner", "full").select("owner", F.coalesce("label", "further", "owner").alias("label"), "links"), "minhash-texts")
    known = members.join(texts.hint("merge"), "owner", "left").groupBy("doc_id").agg(F.min(F.coalesce("label", "owner")).alias("label"), F.max("links").alias("links"))
    return signed.select("doc_id").join(known.hint("merge"), "doc_id", "left").select("doc_id", F.coalesce("label", "doc_id").alias("class_id"), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"))


def representatives(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """One document of each class, that with the smallest id; columns as in ``docs``."""
    kept = classes(docs, similar).where("doc_id is null or class_id = doc_id").select(F.col("doc_id").alias("__id")).distinct()
    return docs.join(kept.hint("merge"), F.col("doc_id").eqNullSafe(F.col("__id")), "left_semi")
