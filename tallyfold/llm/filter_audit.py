"""How text filters interact, in every order of applying them: wide packed counters.

Each document has a mask, one bit for each filter that it fails. What happens to it in each of the 600 steps (120 orders
of five filters) follows from its mask alone, and is packed into one big integer: a field for each step that holds 1 if
the document is removed in that step, then as many fields for removals of good documents and for those of toxic ones.
The integers of a part's documents are summed, and the sum's fields are the counts. A field is as wide as the number of
documents of its part, so no field can run over into the next one.

Documents are counted by part, mask and label before the sum, so that a mask's integer is added as often as it occurs
by one multiplication: what comes to the task of a part is at most 128 rows, whatever the number of documents.

Filters, each a condition of failure:

- A: under ``LEAST_WORDS`` words, B: 100 * distinct words < 50 * words, C: 100 * capital letters of ASCII > 2 * code points,
- D: holds one of ``#$%&*|``, E: the same text has a smaller doc_id somewhere in the table, removed there or not.

Copies are found by the hash of the text, from sums over (text, part, label): no row meets all its copies, so a group
of copies of any size is spread.

Cases: a null text is the empty text (it fails A, and B as little as C); words are maximal runs of other characters than
blank and \\t to \\r; rows without doc_id have no smaller one and no label, and fail E never; rows that repeat an id and a
text fail E alike; the least of repeated labels counts as good or toxic if any of them is; a null source is the part '';
an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

LETTERS = "ABCDE"
LEAST_WORDS = 200
ORDERS = ["".join(p) for p in itertools.permutations(LETTERS)]
STEPS = len(ORDERS) * len(LETTERS)
WORD = r"[^\x20\x09-\x0D]+"
COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
SCHEMA = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS)


def failures(text: Column) -> Column:
    """The bits of the filters that look at a text alone, A the lowest."""
    # bound to a lambda, the words of a text are found once
    words = F.array(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)))
    of_words = F.transform(words, lambda w: F.when(F.size(w) < LEAST_WORDS, 1).otherwise(0) + F.when(100 * F.size(F.array_distinct(w)) < 50 * F.size(w), 2).otherwise(0))[0]
    n = F.length(text)
    capitals = n - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return of_words + F.when(100 * capitals.cast("long") > 2 * n, 4).otherwise(0) + F.when(text.rlike(r"[#$%&*|]"), 8).otherwise(0)


def masked(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, good, toxic, n): how many documents of a part fail just these filters."""
    body = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id"), F.coalesce("source", F.lit("")).alias("part"), F.unhex(F.sha2(body, 256)).alias("h"), failures(body).alias("own"))
    rows = rows.groupBy("doc_id", "part", "h", "own").agg(F.count(F.lit(1)).alias("n"))
    known = labels.where("doc_id is not null").groupBy("doc_id").agg(F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    # rows without an id meet nothing: they are dealt by their text
    key, has_id = F.coalesce(F.col("doc_id"), F.xxhash64("h")), F.col("doc_id").isNotNull()
    known = known.select(F.col("doc_id").alias("__k"), F.lit(True).alias("__known"), "good", "toxic")
    rows = rows.withColumns({"__key": key, "__has": has_id}).join(known.hint("merge"), F.expr("__key = __k and __has = __known"), "left")
    rows = rows.select("doc_id", "part", "h", "own", "n", *(F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")))
    by_text = rows.groupBy("h", "own", "part", "good", "toxic").agg(
        F.sum("n").alias("n"), F.min("doc_id").alias("first"), F.coalesce(F.sum(F.when(F.col("doc_id").isNull(), F.col("n"))), F.lit(0)).alias("without"), F.min_by("n", "doc_id").alias("at_first"),
    )
    # a text has a row for each part and label at most
    least = F.min("first").over(W.partitionBy("h"))
    passing = F.col("without") + F.when(F.col("first") == least, F.col("at_first")).otherwise(0)
    split = by_text.withColumn("passing", passing).select("part", "good", "toxic", F.explode(F.array(F.struct(F.col("own").alias("mask"), F.col("passing").alias("n")), F.struct((F.col("own") + 16).alias("mask"), (F.col("n") - F.col("passing")).alias("n")))).alias("x"))
    return split.groupBy("part", "x.mask", "good", "toxic").agg(F.sum("x.n").alias("n")).where("n > 0")


def removals(mask: int) -> Iterator[int]:
    """For each of the 600 steps, order by order, whether a document of this mask is removed there."""
    for order in ORDERS:
        gone = 0
        for letter in order:
            hit = mask >> LETTERS.index(letter) & 1 & ~gone
            gone |= hit
            yield hit


def packed(mask: int, width: int) -> int:
    """The 600 outcomes of a mask in one integer, ``width`` bits each, the first step lowest."""
    return sum(hit << width * at for at, hit in enumerate(removals(mask)))


def unpacked(number: int, width: int, fields: int) -> list[int]:
    bits = (1 << width) - 1
    return [number >> width * at & bits for at in range(fields)]


def _audit(part: pd.DataFrame) -> pd.DataFrame:
    """The 600 rows of one part from its counts by mask and label, 128 at most."""
    total = int(part["n"].sum())
    width = total.bit_length()
    groups = STEPS * width
    number, failing, alone = 0, [0] * 5, [0] * 5
    for mask, good, toxic, n in zip(part["mask"].tolist(), part["good"].tolist(), part["toxic"].tolist(), part["n"].tolist()):
        one = packed(mask, width)
        number += (one + (one << groups) * bool(good) + (one << 2 * groups) * bool(toxic)) * n
        for k in range(5):
            failing[k] += n * (mask >> k & 1)
            alone[k] += n * (mask == 1 << k)
    removed, good_lost, toxic_lost = (unpacked(number >> k * groups & (1 << groups) - 1, width, STEPS) for k in range(3))
    shapley = [0] * 5
    for order_at, order in enumerate(ORDERS):
        for step, letter in enumerate(order):
            shapley[LETTERS.index(letter)] += removed[5 * order_at + step]
    out, name = [], part["part"].iloc[0]
    for order_at, order in enumerate(ORDERS):
        kept = total
        for step, letter in enumerate(order):
            at, k = 5 * order_at + step, LETTERS.index(letter)
            kept -= removed[at]
            out.append((name, order, step + 1, kept, removed[at], failing[k] - removed[at], alone[k], good_lost[at], toxic_lost[at], shapley[k]))
    return pd.DataFrame(out, columns=["part", "filter_order", "step", *COUNTS])


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley).

    ``docs`` has (doc_id, source, text), ``labels`` (doc_id, quality, toxic). ``shapley`` is the sum of the filter's
    removals over all orders, 120 times its mean share of what the five remove.
    """
    return masked(docs, labels).groupBy("part").applyInPandas(_audit, SCHEMA)
