"""Aggregations: cause pivots, majorities, quantiles, shares, profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyfold.operators import ranks
from tallyfold.sources.readers import row_hash


def cause_pivot(facts: DataFrame, keys: list[str], causes: list[str], cause: str = "cause", value: str = "total") -> DataFrame:
    """Sums by cause as columns ``n_<cause>``; a cause that a group never reports stays null."""
    sums = [F.sum(F.when(F.col(cause) == c, F.col(value))).alias(f"n_{c}") for c in causes]
    return facts.groupBy(*keys).agg(*sums)


def distinct_reporters(facts: DataFrame, keys: list[str], unit: str) -> DataFrame:
    return facts.groupBy(*keys).agg(F.count_distinct(unit).alias("reporters"))


def majority(members: DataFrame, unit: str, group: str) -> DataFrame:
    """(unit, group, share, tie): the group with most members of each unit; ``tie`` where it is not alone."""
    n = members.groupBy(unit, group).agg(F.count("*").alias("n"))
    w = W.partitionBy(unit)
    ranked = n.withColumns({"share": F.col("n") / F.sum("n").over(w), "r": F.rank().over(w.orderBy(F.desc("n")))})
    best = ranked.where("r = 1").groupBy(unit).agg(F.min(group).alias(group), F.max("share").alias("share"), (F.count("*") > 1).alias("tie"))
    return best


def weighted_quantile(df: DataFrame, group: str, value: str, weight: str, qs: list[float]) -> DataFrame:
    """Smallest value whose cumulated weight reaches each share of the group's weight."""
    by_value = df.groupBy(group, value).agg(F.sum(weight).alias("w"))
    total = F.sum("w").over(W.partitionBy(group))
    cum = F.sum("w").over(W.partitionBy(group).orderBy(value).rowsBetween(W.unboundedPreceding, 0))
    at = by_value.withColumns({"cum": cum, "all": total})
    return at.groupBy(group).agg(*(F.min(F.when(F.col("cum") >= q * F.col("all"), F.col(value))).alias(f"q{round(q * 100):02d}") for q in qs))


def breakdown(df: DataFrame, keys: list[str], dimensions: list[str]) -> DataFrame:
    """(keys, dimension, category, n): counts of every dimension in one long table."""
    long = df.select(*keys, *(F.col(d).cast("string").alias(d) for d in dimensions)).unpivot(keys, dimensions, "dimension", "category")
    return long.groupBy(*keys, "dimension", "category").agg(F.count("*").alias("n"))


def complete_years(df: DataFrame, keys: list[str], year: str, month: str) -> DataFrame:
    """Years in which all twelve months occur."""
    return df.groupBy(*keys, year).agg(F.count_distinct(month).alias("months")).where("months = 12").drop("months")


def ranked_shares(df: DataFrame, key: str, year: str, value: str) -> DataFrame:
    """(key, by_year, total, share, rank), from sums that are taken before the ranking; ``by_year`` lists (year, value)."""
    by_year = df.groupBy(key, year).agg(F.sum(value).alias(value))
    sums = by_year.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(year, value))).alias("by_year"), F.sum(value).alias("total"))
    placed = ranks.running(sums, [F.desc("total"), F.col(key)], rank="rank")
    # one row
    every = placed.agg(F.sum("total").alias("__all"))
    return placed.crossJoin(F.broadcast(every)).select(key, "by_year", "total", F.try_divide("total", "__all").alias("share"), "rank")


#: Up to so many values, by a sketch, a column's values are gathered as a set of hashes.
SET_BOUND = 10_000


def profile(df: DataFrame, columns: list[str], bound: int = SET_BOUND) -> DataFrame:
    """(column, nulls, blanks, distinct, negatives); no row is ever multiplied by the number of columns.

    The first scan takes all counts and a sketch of each column's distinct values. Columns with few of them are counted
    together in a second scan, by sets of 64-bit hashes that no task can see grow past the bound by more than the
    sketch's error. Each other column is counted exactly on its own, from its values alone: one shuffle of what is left
    of them after each task has dropped its repeats. An empty table has zeros everywhere.
    """
    kinds = ("nulls", "blanks", "distinct", "negatives")
    aggs = []
    for k, c in enumerate(columns):
        text = F.trim(F.col(c).cast("string"))
        aggs += [F.count_if(F.col(c).isNull()).alias(f"nulls{k}"), F.count_if(text.isin("", "*")).alias(f"blanks{k}"), F.approx_count_distinct(c, 0.02).alias(f"distinct{k}"), F.count_if(F.coalesce(text.try_cast("double"), F.lit(0.0)) < 0).alias(f"negatives{k}")]
    found = df.agg(*aggs).first()
    few = [k for k in range(len(columns)) if found[f"distinct{k}"] <= bound]
    exact = df.agg(*(F.size(F.collect_set(F.when(F.col(columns[k]).isNotNull(), F.xxhash64(columns[k])))).cast("long").alias(f"distinct{k}") for k in few)).first() if few else {}
    rows = []
    for k, c in enumerate(columns):
        n = exact[f"distinct{k}"] if k in few else df.where(F.col(c).isNotNull()).select(c).distinct().count()
        rows.append((c, found[f"nulls{k}"], found[f"blanks{k}"], n, found[f"negatives{k}"]))
    return df.sparkSession.createDataFrame(rows, "column string, " + ", ".join(f"{k} long" for k in kinds))


def extra_copies(df: DataFrame, columns: list[str]) -> DataFrame:
    """(groups, extra): groups of equal rows and rows beyond the first of each."""
    n = df.groupBy(row_hash(columns).alias("h")).agg(F.count("*").alias("n"))
    return n.agg(F.count_if(F.col("n") > 1).alias("groups"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("extra"))


def cumulative_share(totals: DataFrame, key: str, value: str, cut: float) -> DataFrame:
    """(key, share, running, within): shares from the largest down, and whether they are needed to reach the cut."""
    placed = ranks.running(totals.select(key, value), [F.desc_nulls_last(value), F.col(key)], {"__run": F.col(value)})
    # one row
    every = placed.agg(F.sum(value).alias("__all"))
    shares = placed.crossJoin(F.broadcast(every)).select(key, F.try_divide(value, "__all").alias("share"), F.try_divide("__run", "__all").alias("running"))
    return shares.withColumn("within", F.col("running") - F.col("share") < cut).select(key, "share", "running", "within")


def sum_over_sum(numerator: str, denominator: str) -> Column:
    """A ratio of sums, never a mean of ratios; null where the denominator is 0."""
    return F.when(F.sum(denominator) > 0, F.sum(numerator) / F.sum(denominator))
