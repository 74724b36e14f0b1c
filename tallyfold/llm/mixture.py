"""Mixing sources to target weights by a low-discrepancy schedule; DataFrame operations only.

Each source is a stream of its documents in an order shuffled by a keyed hash, and the stream may run twice.
The mix is a schedule of slots of equal token counts. The point of slot j, frac((j + 1) * golden ratio), falls
into one source's share of the cumulated targets, in blocks; the slots of a source are ranked, and rank r takes block r
of the source's stream. A source's share is the blocks that its own target needs, one at least, and its last block is
cut to what is left of the target. A block is taken because a slot fell to it, and not otherwise; so any run of slots
holds each source within a few blocks of its share. A document's ``taken`` words are those of its stream positions that
taken blocks cover, its place in the mix is the first slot that takes of it.

Targets: sources in code point order, null last, weigh 3, 1, 2 in turn and share ``FACTOR`` times all words. A
target stops at ``REPEATS`` times its source's words, and what is over is shared by weight among the rest. That
is filling to a level: in the order of limit / weight, a source is full while its limit is under the level that
the rest would share.

Running sums are taken in two steps (buckets of the hash, then within a bucket), so a hot source is never in one
task. The schedule has about ``SLOTS`` slots at any size, so slots grow with the input; a source's taken words are
its target, rounded to a word, however small the source.

Cases: null and empty texts have no words and are never taken; repeated rows count each, and rows of one source that
share an id, or have none, are put in order in one task; an empty table gives no rows; a source without words has target 0; extra columns are ignored by ``plan``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyfold.llm.common import settle

WEIGHTS = (3, 1, 2)
FACTOR, REPEATS = 1.5, 2
SLOTS = 1 << 16
GOLDEN = 0.6180339887498949
BUCKETS = 4096
WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """Number of words of a text."""
    return F.size(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, target, lo, hi): one row per source; its share of [0, 1) of the cumulated targets."""
    of = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = W.orderBy(F.col("source").isNull(), "source")
    order = F.row_number().over(by_name)
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), ((order - 1) % len(WEIGHTS) + 1).cast("int"))
    of = of.select("source", "source_size", order.alias("at"), weight.cast("double").alias("weight"), (F.lit(float(REPEATS)) * F.col("source_size")).alias("limit"))
    full_first = W.orderBy(F.col("limit") / F.col("weight"), "at")
    before = full_first.rowsBetween(W.unboundedPreceding, -1)
    rest = full_first.rowsBetween(0, W.unboundedFollowing)
    every = W.partitionBy()
    of = of.withColumn("level", (F.lit(FACTOR) * F.sum("source_size").over(every) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / F.sum("weight").over(rest))
    of = of.withColumn("open", F.col("limit") / F.col("weight") > F.col("level"))
    # the level of the first source that is not full holds for all after it
    of = of.withColumn("open_at", F.min(F.when(F.col("open"), F.struct(F.col("limit") / F.col("weight"), F.col("at"), F.col("level")))).over(every))
    key = F.struct(F.col("limit") / F.col("weight"), F.col("at"), F.col("level"))
    of = of.withColumn("target", F.when(F.col("open_at").isNull() | (key < F.col("open_at")), F.col("limit")).otherwise(F.col("open_at")["level"] * F.col("weight")))
    of = of.withColumn("sum", F.sum("target").over(every)).withColumn("hi", F.sum("target").over(W.orderBy("at").rowsBetween(W.unboundedPreceding, 0)))
    return of.select("source", "source_size", "target", F.expr("try_divide(hi - target, sum)").alias("lo"), F.expr("try_divide(hi, sum)").alias("hi"), F.col("sum").alias("budget"))


def schedule(shares: DataFrame) -> DataFrame:
    """(source, slot, block, words): slots in order; ``block`` is the slot's rank in its source, ``words`` its length.

    The sequence goes on until every source has met its blocks, twice their number of points as a rule; what falls to a
    source that has all its blocks is passed over. A source that no point falls to has no blocks.
    """
    spark = shares.sparkSession
    budget = shares.agg(F.coalesce(F.max("budget"), F.lit(0.0))).first()[0]
    length = max(1, round(budget / SLOTS))
    own = shares.select("source", F.round("target").cast("long").alias("whole")).where("whole > 0").withColumn("blocks", F.ceil(F.col("whole") / length))
    by_name = W.orderBy(F.col("source").isNull(), "source").rowsBetween(W.unboundedPreceding, 0)
    own = settle(own.withColumn("hi", F.sum("blocks").over(by_name)), "mixture-blocks")
    total = own.agg(F.coalesce(F.max("hi"), F.lit(0))).first()[0]
    # each unit of the cumulated blocks belongs to one source
    units = own.select("source", "whole", "blocks", F.explode(F.sequence(F.col("hi") - F.col("blocks"), F.col("hi") - 1)).alias("unit"))
    for n in (2 * total, 8 * total):
        points = spark.range(n).select(F.col("id").alias("slot"), F.least(F.floor((F.col("id") + 1) * F.lit(GOLDEN) % 1.0 * total), F.lit(total - 1)).alias("unit"))
        rank = F.row_number().over(W.partitionBy("source").orderBy("slot")) - 1
        placed = points.join(units.hint("shuffle_hash"), "unit").withColumn("block", rank.cast("long")).where("block < blocks")
        placed = settle(placed.select("source", "slot", "block", F.least(F.lit(length), F.col("whole") - F.col("block") * length).cast("long").alias("words")), "mixture-slots")
        if placed.count() == total:
            break
    return placed


def numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with a row number that stays: written to the shared folder and read back."""
    return settle(docs.withColumn("row", F.monotonically_increasing_id()), "mixture-rows")


def plan(docs: DataFrame, seed: int = 11, row: str | None = None) -> DataFrame:
    """``docs`` has (doc_id, source, text); ``row`` names a column with a number of its own for each row, if there is one.

    Returns (row, doc_id, source, size, source_size, target, first, second, first_slot, second_slot, taken): words taken of each document.

    ``first`` and ``second`` are the words that the first and the second run of the stream take, as an array
    (from, to) of the word numbers, or null; ``first_slot`` and ``second_slot`` are the slots where they begin.
    """
    sizes = settle(
        docs.select((F.col(row) if row else F.monotonically_increasing_id()).alias("row"), "doc_id", "source", words(F.col("text")).alias("size"), F.xxhash64(F.lit(seed), "doc_id").alias("h")),
        "mixture-sizes",
    ).withColumn("bucket", F.pmod("h", F.lit(BUCKETS)))
    shares = settle(targets(sizes), "mixture-targets")
    slots = schedule(shares)
    by_bucket = sizes.groupBy("source", "bucket").agg(F.sum("size").alias("n"))
    offset = by_bucket.withColumn("offset", F.coalesce(F.sum("n").over(W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("n")
    # what is known of a source reaches its documents by bucket too, so that no source is one key
    of_source = shares.select(F.col("source").alias("source3"), "source_size", "target", "budget")
    offset = offset.join(of_source.hint("shuffle_hash"), F.col("source").eqNullSafe(F.col("source3"))).drop("source3").withColumnRenamed("source", "source2").withColumnRenamed("bucket", "bucket2")
    within = W.partitionBy("source", "bucket").orderBy("h", "doc_id", "size", "row").rowsBetween(W.unboundedPreceding, -1)
    placed = sizes.withColumn("inside", F.coalesce(F.sum("size").over(within), F.lit(0)))
    placed = placed.join(offset.hint("shuffle_hash"), F.col("source").eqNullSafe(F.col("source2")) & (F.col("bucket") == F.col("bucket2"))).withColumn("start", F.col("offset") + F.col("inside")).drop("source2", "bucket2", "h", "inside", "offset")
    length = F.greatest(F.lit(1), F.round(F.col("budget") / SLOTS).cast("long"))
    runs = placed.where("size > 0").withColumn("length", length).withColumn("run", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("from", F.col("start") + F.col("run") * F.col("source_size")).withColumn("to", F.col("from") + F.col("size"))
    pieces = runs.select("row", "run", "source", "from", "to", "length", F.explode(F.sequence(F.expr("`from` div length"), F.expr("(`to` - 1) div length"))).alias("block"))
    taken = pieces.alias("p").join(slots.select(F.col("source").alias("source2"), F.col("block").alias("block2"), "words", "slot").hint("shuffle_hash"), F.expr("source <=> source2 and block = block2"))
    low, high = F.greatest("from", F.col("block") * F.col("length")), F.least("to", F.col("block") * F.col("length") + F.col("words"))
    taken = taken.where(low < high).select("row", "run", "slot", (low - F.col("from")).alias("a"), (high - F.col("from")).alias("b"))
    span = lambda k: F.when(F.count(F.when(F.col("run") == k, 1)) > 0, F.array(F.min(F.when(F.col("run") == k, F.col("a"))), F.max(F.when(F.col("run") == k, F.col("b")))))
    at = lambda k: F.min(F.when(F.col("run") == k, F.col("slot"))).alias(("first_slot", "second_slot")[k])
    by_row = taken.groupBy("row").agg(span(0).alias("first"), span(1).alias("second"), at(0), at(1), F.sum(F.col("b") - F.col("a")).alias("taken"))
    out = placed.join(by_row.hint("shuffle_hash"), "row", "left")
    return out.select("row", "doc_id", "source", "size", "source_size", "target", "first", "second", "first_slot", "second_slot", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mix(docs: DataFrame, seed: int = 11) -> DataFrame:
    """The documents of the mix in the order of their slots, with the columns of ``docs``: one row for each run that takes words of a document.

    A document that is taken whole keeps its text; where the mix ends inside it, the text is the taken words,
    joined by spaces. ``n_chars``, if there, follows the text.
    """
    columns = docs.columns
    kept = numbered(docs.select(F.struct(*columns).alias("doc")))
    found = plan(kept.select("row", "doc.doc_id", "doc.source", "doc.text"), seed, row="row").where("taken > 0")
    runs = F.array(*(F.struct(F.col(span).alias("span"), F.col(slot).alias("slot")) for span, slot in (("first", "first_slot"), ("second", "second_slot"))))
    chosen = found.select("row", "size", F.explode(runs).alias("run")).where("run.span is not null")
    span, text = F.col("run.span"), F.col("doc.text")
    part = F.array_join(F.slice(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), (span[0] + 1).cast("int"), (span[1] - span[0]).cast("int")), " ")
    new = F.when((span[0] == 0) & (span[1] == F.col("size")), text).otherwise(part)
    out = kept.join(chosen.hint("merge"), "row").select("doc", F.col("run.slot").alias("slot"), "row", new.alias("new")).orderBy("slot", "row")
    changed = {"text": F.col("new")} | ({"n_chars": F.length("new").cast(docs.schema["n_chars"].dataType)} if "n_chars" in columns else {})
    return out.select(*(changed.get(c, F.col("doc").getField(c)).alias(c) for c in columns))
