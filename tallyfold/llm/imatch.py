"""I-Match fingerprints over randomised lexicon subsets; DataFrame operations only.

The lexicon holds the terms (lower-case runs of letters and digits) whose document frequency, counted over all
documents, lies in the band [``LOW``, ``HIGH``] of the documents, and in two documents at least. A text that has many
exact copies counts once, so that a large group of copies does not put its terms over the band. Each term of the
band lies in ``DEALS`` of ``SUBSETS`` lexicon subsets, chosen by a hash, so that subsets overlap. For each subset the
distinct terms of a text that lie in it are sorted and hashed; the fingerprint is the row of these hashes, ``------``
where a text has no term of the subset. The likeness of two fingerprints is the share of equal hashes among the subsets
where either has one.

Terms out of the band never enter the fingerprint of a text that has enough of the band: one in ``NEED`` of its distinct
terms. A text with fewer, as near copies of a text that a large share of documents holds, whose terms are all over the
band, or a text of rare words alone, is known by all of its terms instead, dealt to subsets alike. A text without terms
is known by a hash of the whole text.

The lexicon is broadcast while it has at most ``MOST_TERMS``: there are at most (mean number of distinct terms) / ``LOW``
of them, whatever the number of documents. The texts are shuffled once, into buckets of
neighbouring ids of about ``BUCKET_ROWS``, and all that follows (the next document's text, the terms, the hashes) keeps
that partitioning; only the first text of each bucket goes to the bucket before as well.

Cases: null text is the empty text; equal texts have equal fingerprints; equal ids are ordered by a hash of their
texts, by which ids that many rows share, and null ids, are cut into buckets too; null ids come last; the next
document of the only one is itself; texts of any length are read whole; an empty table gives no rows; extra columns
are ignored.
"""

from __future__ import annotations

import collections
import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyfold.llm.common import settle

LOW, HIGH = 1 / 2000, 1 / 40
SUBSETS, DEALS = 192, 2
#: Bits of a term's hash; the number of a subset, 8 bits, stands over them.
BITS = 55
SEED = 17
#: A text is known by its terms of the band if they are one in so many of its terms.
NEED = 8
#: Documents of one bucket, and the most buckets; beyond them buckets grow, which sort and window spill.
BUCKET_ROWS, MOST_BUCKETS = 1000, 1 << 16
MOST_TERMS = 4_000_000
#: A text counts once if it is this share of ``HIGH`` of the documents at least.
HEAVY = 0.1
MARK = "\x01"


def terms(text: Column) -> Column:
    """The distinct terms of a text."""
    return F.array_distinct(F.split(F.lower(text), r"[^\p{L}\p{N}]+"))


def lexicon(docs: DataFrame, low: float = LOW, high: float = HIGH) -> DataFrame:
    """(term, in_band): the terms in the band."""
    total = docs.count()
    body = F.coalesce("text", F.lit(""))
    # at most 1 / (HEAVY * high) rows
    heavy = docs.groupBy(F.xxhash64(body).alias("same")).agg(F.count(F.lit(1)).alias("copies")).where(F.col("copies") >= max(2, HEAVY * high * total))
    rows = docs.select(body.alias("body"), F.xxhash64(body).alias("same")).join(F.broadcast(heavy), "same", "left").select("body", (1 / F.coalesce("copies", F.lit(1))).alias("weight"))
    found = rows.select("weight", F.explode(terms(F.col("body"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("rows"), F.round(F.sum("weight"), 6).alias("df"))
    kept = found.where((F.col("term") != "") & (F.col("rows") >= 2) & (F.col("df") >= low * total) & (F.col("df") <= max(2, high * total)))
    return settle(kept.select("term", F.lit(True).alias("in_band")), "imatch-lexicon")


def _cut(ids: Column, cuts: list[int]) -> Column:
    """How many of ``cuts`` are over an id, or a number in the same order; two short searches for long lists."""
    down, width = sorted(set(cuts), reverse=True), max(1, math.isqrt(len(cuts)))
    chunks = [down[k : k + width] for k in range(0, len(down), width)]
    coarse = F.from_json(F.lit(json.dumps([c[-1] for c in chunks])), "array<bigint>")
    fine = F.from_json(F.lit(json.dumps(chunks)), "array<array<bigint>>")
    over = F.size(F.filter(coarse, lambda c: c > ids))
    return over * width + F.coalesce(F.size(F.filter(F.try_element_at(fine, over + 1), lambda c: c > ids)), F.lit(0))


def bucketed(docs: DataFrame) -> DataFrame:
    """(bucket, doc_id, text, tie): buckets in the order of falling ids, null ids last."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    buckets = max(1, min(MOST_BUCKETS, docs.count() // BUCKET_ROWS))
    asked = [k / buckets for k in range(1, buckets)] or [0.5]
    cuts = rows.agg(F.percentile_approx("doc_id", asked, max(10_000, 4 * buckets)).alias("cuts")).first()["cuts"] or [0]
    # an id that fills several quantiles is cut by the hash of the text
    hot = sorted(k for k, n in collections.Counter(cuts).items() if n > 1)
    by_tie = F.shiftright("tie", 56) + 129
    sub = F.when(F.col("doc_id").isin(hot), by_tie).otherwise(0) if hot else F.lit(0)
    place = _cut(F.col("doc_id"), cuts) * 512 + sub
    return rows.withColumn("bucket", F.when(F.col("doc_id").isNull(), (1 << 40) + by_tie).otherwise(place).cast("long"))


def neighbours(docs: DataFrame) -> DataFrame:
    """(bucket, at, doc_id, text, next_text, last): each text with that of the next smaller id; circular.

    ``last`` marks the last row of a bucket, whose next text comes from another bucket.
    """
    rows = bucketed(docs)
    order = F.struct(F.bitwise_not("doc_id"), F.col("tie"))
    # (bucket, key of its first row), one row per bucket; and which bucket comes before it
    first = settle(rows.groupBy("bucket").agg(F.min(order).alias("head")), "imatch-heads")
    by_bucket = W.orderBy("bucket")
    first = first.select(F.col("bucket").alias("own"), "head", F.coalesce(F.lag("bucket").over(by_bucket), F.last("bucket").over(by_bucket.rowsBetween(0, W.unboundedFollowing))).alias("before"))
    heads = rows.join(F.broadcast(first), (F.col("bucket") == F.col("own")) & order.eqNullSafe(F.col("head"))).select(F.col("before").alias("bucket"), "text", "tie")
    heads = heads.groupBy("bucket").agg(F.min_by("text", "tie").alias("text"))
    every = rows.withColumn("guest", F.lit(0)).unionByName(heads.withColumn("guest", F.lit(1)), allowMissingColumns=True)
    within = W.partitionBy("bucket").orderBy("guest", F.desc_nulls_last("doc_id"), "tie")
    follows = F.lead(F.struct("text", "guest")).over(within)
    placed = every.withColumn("follows", follows).withColumn("at", F.row_number().over(within)).where("guest = 0")
    return placed.select("bucket", "at", "doc_id", "text", F.col("follows")["text"].alias("next_text"), (F.col("follows")["guest"] == 1).alias("last"))


def packed(in_band: Column, term: Column) -> Column:
    """Hash of a term in 55 bits, and over them a bit for terms out of the band."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(SEED), term), 64 - BITS).bitwiseOR(F.when(in_band, F.lit(0)).otherwise(F.lit(1 << BITS)))


def counted(numbers: Column) -> Column:
    """The ``packed`` terms that a text is known by: those of the band, or all if there are too few of them."""
    band = F.filter(numbers, lambda x: x < (1 << BITS))
    return F.when(F.size(band) * NEED >= F.size(numbers), band).otherwise(F.transform(numbers, lambda x: x.bitwiseAND(F.lit((1 << BITS) - 1))))


def dealt(numbers: Column) -> Column:
    """Each term once for each of its subsets, whose number stands over the hash; other bits of the hash choose each."""
    width = SUBSETS // DEALS
    subset = lambda x, k: F.lit(k * width) + F.pmod(F.shiftright(x, 8 * k), F.lit(width))
    return F.flatten(F.transform(numbers, lambda x: F.array(*(F.shiftleft(subset(x, k), BITS).bitwiseOR(x) for k in range(DEALS)))))


def subset_hashes(numbers: Column) -> Column:
    """Hash by subset from an array of ``dealt`` terms."""
    entry = lambda s: F.array_append(s["done"], F.struct(s["group"].cast("int").alias("subset"), s["hash"].alias("hash")))
    state = lambda group, h, done: F.struct(group.alias("group"), h.alias("hash"), done.alias("done"))

    def step(s, x):
        group = F.shiftright(x, BITS)
        return F.when(s["group"] == group, state(s["group"], F.xxhash64(s["hash"], x), s["done"])).otherwise(state(group, F.xxhash64(F.lit(SEED), x), entry(s)))

    start = state(F.lit(-1).cast("long"), F.lit(0).cast("long"), F.array().cast("array<struct<subset:int,hash:bigint>>"))
    return F.aggregate(F.sort_array(numbers), start, step, lambda s: F.map_from_entries(entry(s)))


def _fingerprint(by_subset: Column, whole: Column) -> Column:
    """Array of hashes, 6 hexadecimal digits each; the whole text's hash alone if no subset has a term."""
    digits = lambda h: F.lpad(F.lower(F.hex(h.bitwiseAND(F.lit(0xFFFFFF)))), 6, "0")
    row = F.transform(F.sequence(F.lit(0), F.lit(SUBSETS - 1)), lambda k: F.coalesce(digits(F.element_at(by_subset, k)), F.lit("------")))
    return F.when(F.size(by_subset) > 1, row).otherwise(F.array(F.concat(F.lit("text:"), F.hex(whole))))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal hashes of two fingerprints (arrays) among the places where either has one."""
    both = F.zip_with(a, b, lambda x, y: F.when((x == "------") & (y == "------"), F.lit(None)).otherwise(F.when(x == y, 1.0).otherwise(0.0)))
    known = F.filter(both, lambda x: x.isNotNull())
    return F.when(F.size(a) != F.size(b), F.lit(0.0)).otherwise(F.aggregate(known, F.lit(0.0), lambda s, x: s + x) / F.size(known))


def fingerprints(docs: DataFrame, low: float = LOW, high: float = HIGH) -> DataFrame:
    """One row per document: its fingerprint, that of its edited text, and their likeness.

    The edited text is the document's without its last third, followed by as many code points of the next
    document's text.
    """
    lex = lexicon(docs, low, high)
    lex = F.broadcast(lex) if lex.count() <= MOST_TERMS else lex.hint("merge")
    near = neighbours(docs)
    n = F.length("text")
    third = F.floor(n / 3).cast("int")
    near = near.withColumn("n_chars", n.cast("long")).withColumn("edited", F.concat(F.substring("text", F.lit(1), n - third), F.substring("next_text", F.lit(1), third)))
    entry = lambda k, text: F.struct(F.lit(k).alias("which"), text.alias("body"))
    texts = near.select("bucket", "at", F.named_struct(F.lit("doc_id"), "doc_id", F.lit("n_chars"), "n_chars", F.lit("edited_sha256"), F.sha2("edited", 256)).alias("about"), F.explode(F.array_compact(F.array(entry(0, F.col("text")), entry(1, F.col("edited")), F.when(F.col("last"), entry(2, F.col("next_text")))))).alias("t"))
    # the mark is a row that every text has, and brings what is known of it through the join
    words = texts.select("bucket", "at", "t.which", F.named_struct(F.lit("about"), "about", F.lit("whole"), F.xxhash64("t.body")).alias("about"), F.explode(F.concat(F.array(F.lit(MARK)), terms(F.col("t.body")))).alias("term"))
    words = words.select("bucket", "at", "which", "term", F.when(F.col("term") == MARK, F.col("about")).alias("about"))
    words = words.where("term <> ''").join(lex, "term", "left")
    by_text = words.groupBy("bucket", "at", "which").agg(
        F.first("about", ignorenulls=True).alias("known"), F.collect_list(F.when(F.col("term") != MARK, packed(F.coalesce("in_band", F.lit(False)), F.col("term")))).alias("numbers")
    )
    # bound to a lambda, the hashes of a text are made once
    printed = by_text.select("bucket", "at", "which", F.col("known.about").alias("about"), F.transform(F.array(subset_hashes(dealt(counted(F.col("numbers"))))), lambda m: _fingerprint(m, F.col("known.whole")))[0].alias("print"))
    pick = lambda k: F.first(F.when(F.col("which") == k, F.col("print")), ignorenulls=True)
    rows = printed.groupBy("bucket", "at").agg(F.first("about", ignorenulls=True).alias("about"), pick(0).alias("own"), pick(1).alias("edited"), pick(2).alias("over"))
    following = F.coalesce(F.lead("own").over(W.partitionBy("bucket").orderBy("at")), F.col("over"))
    rows = rows.withColumn("following", following)
    return rows.select(
        "about.doc_id", "about.n_chars", "about.edited_sha256",
        F.array_join("own", "").alias("fingerprint"), F.array_join("edited", "").alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("edited")).alias("near_edited"), likeness(F.col("own"), F.col("following")).alias("near_next"),
    )
