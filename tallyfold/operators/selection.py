"""Exact quantiles of large groups by selection: counts by bin, then by bins of the bin that holds the rank.

Spark's ``percentile`` keeps all distinct values of a group in one task. Here each round counts a group's values in
``BINS`` bins of equal width between two bounds, and the next round looks only at the bin where a wanted rank falls, so a
group of any size is a few rows in every shuffle. A group whose open bin holds at most ``SMALL`` values is then sorted.
Values that repeat are counted, not listed: a bin that cannot be cut further holds one value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyfold.sources import shared

BINS, SMALL, ROUNDS = 1024, 10_000, 12


def quantiles(df: DataFrame, keys: list[str], value: str, qs: list[float], bins: int = BINS, small: int = SMALL) -> DataFrame:
    """(keys, n, quantiles): interpolated quantiles of each group, as ``percentile`` gives; nulls and NaN are left out.

    A wanted quantile lies between the two neighbouring ranks floor and ceil of q * (n - 1); each pair is looked for on
    its own. Small groups need no round: those of at most ``small`` values are sorted at once.
    """
    rows, groups = _prepared(df, keys, value)
    large = groups.where(F.col("n") > small)
    asked = F.array(*(F.lit(float(q)) for q in qs))
    no_large = large.isEmpty()
    # there are at most (rows / small) large groups
    few = rows if no_large else _without(rows, large, keys)
    out = few.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.percentile("__v", asked).alias("quantiles")).where("n > 0")
    if no_large:
        return out
    return out.unionByName(_large(rows, large, keys, qs, bins, small).select(*keys, "n", "quantiles"))


def order_statistics(df: DataFrame, keys: list[str], value: str, ranks, small: int = SMALL, bins: int = BINS) -> DataFrame:
    """(keys, n, values): the values at the places that ``ranks`` (a function of the column of a group's size) gives, from 1 to n."""
    rows, groups = _prepared(df, keys, value)
    asked = F.array(*(F.least(F.greatest(r.cast("long"), F.lit(1)), F.col("n")) - 1 for r in ranks(F.col("n"))))
    large = groups.where(F.col("n") > small)
    no_large = large.isEmpty()
    few = (rows if no_large else _without(rows, large, keys)).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list("__v")).alias("all")).where("n > 0")
    out = few.withColumn("asked", asked).select(*keys, "n", F.transform("asked", lambda r: F.get("all", r.cast("int"))).alias("values"))
    if no_large:
        return out
    found = _at_ranks(rows, large, keys, F.array_distinct(asked), bins, small)
    return out.unionByName(found.withColumn("asked", asked).select(*keys, "n", F.transform("asked", lambda r: F.element_at("at", r)).alias("values")))


def _prepared(df: DataFrame, keys: list[str], value: str) -> tuple[DataFrame, DataFrame]:
    rows = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select(*keys, F.col(value).cast("double").alias("__v"))
    groups = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("__v").alias("__lo"), F.max("__v").alias("__hi"))
    return rows, shared.kept(groups, "quantile-groups")


def _without(rows: DataFrame, groups: DataFrame, keys: list[str]) -> DataFrame:
    named = groups.select(*(F.col(k).alias(f"__{k}") for k in keys))
    same = F.lit(True)
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"__{k}"))
    return rows.join(F.broadcast(named), same, "left_anti")


def _large(rows: DataFrame, groups: DataFrame, keys: list[str], qs: list[float], bins: int, small: int) -> DataFrame:
    n = F.col("n")
    exact = [F.lit(float(q)) * (n - 1) for q in qs]
    at = _at_ranks(rows, groups, keys, F.array_distinct(F.flatten(F.array(*(F.array(F.floor(x), F.ceil(x)) for x in exact)))), bins, small)
    low, high = ([F.element_at("at", f(x)) for x in exact] for f in (F.floor, F.ceil))
    return at.withColumn("quantiles", F.array(*(a + (b - a) * (x - F.floor(x)) for a, b, x in zip(low, high, exact))))


def _at_ranks(rows: DataFrame, groups: DataFrame, keys: list[str], wanted: Column, bins: int, small: int) -> DataFrame:
    """(keys, n, at): a map from each wanted rank, from 0, to its value."""
    # a search for each group and wanted rank: values in [lo, hi], ``under`` values lie below lo, ``inside`` in it
    n = F.col("n")
    open_ = groups.select(*keys, n, F.explode(wanted).alias("rank"), F.col("__lo").alias("lo"), F.col("__hi").alias("hi"), F.lit(0).cast("long").alias("under"), n.alias("inside"))
    open_, found = shared.kept(open_, "quantile-open"), None
    for _ in range(ROUNDS):
        ready = open_.where((F.col("inside") <= small) | (F.col("lo") == F.col("hi")))
        part = _sorted_out(rows, ready, keys)
        found = part if found is None else found.unionByName(part)
        open_ = open_.where((F.col("inside") > small) & (F.col("lo") < F.col("hi")))
        if open_.isEmpty():
            break
        open_ = shared.kept(_narrower(rows, open_, keys, bins), "quantile-open")
    else:
        found = found.unionByName(_sorted_out(rows, open_, keys))
    found = shared.kept(found, "quantile-found")
    return found.groupBy(*keys, "n").agg(F.map_from_entries(F.collect_list(F.struct("rank", "value"))).alias("at"))


def _inside(rows: DataFrame, open_: DataFrame, keys: list[str]) -> DataFrame:
    """The values that lie between the bounds of a search, with the search; there are as many searches as large groups and ranks."""
    s = open_.select(*(F.col(k).alias(f"__{k}") for k in keys), "n", "rank", "lo", "hi", "under", "inside")
    near = (F.col("__v") >= F.col("lo")) & (F.col("__v") <= F.col("hi"))
    for k in keys:
        near &= F.col(k).eqNullSafe(F.col(f"__{k}"))
    # each search stands for over ``small`` rows: their table is that much smaller than the rows
    return rows.join(F.broadcast(s), near).drop(*(f"__{k}" for k in keys))


def _narrower(rows: DataFrame, open_: DataFrame, keys: list[str], bins: int) -> DataFrame:
    width = (F.col("hi") - F.col("lo")) / bins
    bin_ = F.least(F.floor((F.col("__v") - F.col("lo")) / width), F.lit(bins - 1))
    # bounds of a bin are values of it, so that equal values close it
    by_bin = _inside(rows, open_, keys).groupBy(*keys, "n", "rank", "under", bin_.alias("bin")).agg(F.count(F.lit(1)).alias("c"), F.min("__v").alias("lo"), F.max("__v").alias("hi"))
    before = F.coalesce(F.sum("c").over(W.partitionBy(*keys, "rank").orderBy("bin").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = by_bin.withColumn("under", F.col("under") + before)
    return placed.where((F.col("rank") >= F.col("under")) & (F.col("rank") < F.col("under") + F.col("c"))).select(*keys, "n", "rank", "lo", "hi", "under", F.col("c").alias("inside"))


def _sorted_out(rows: DataFrame, ready: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, rank, value) of searches with few values left, or one."""
    one = ready.where("lo = hi").select(*keys, "n", "rank", F.col("lo").alias("value"))
    counts = _inside(rows, ready.where("lo < hi"), keys).groupBy(*keys, "n", "rank", "under", "__v").agg(F.count(F.lit(1)).alias("c"))
    upto = F.col("under") + F.sum("c").over(W.partitionBy(*keys, "rank").orderBy("__v").rowsBetween(W.unboundedPreceding, 0))
    many = counts.withColumn("upto", upto).where((F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("c")))
    return one.unionByName(many.select(*keys, "n", "rank", F.col("__v").alias("value")))

