"""Windows: runs and gaps, changes of composition, flags of late registration, segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def tail(df: DataFrame, key: str, order: str, n: int) -> DataFrame:
    """The last n rows of each series."""
    r = F.row_number().over(W.partitionBy(key).orderBy(F.desc(order)))
    return df.withColumn("__r", r).where(F.col("__r") <= n).drop("__r")


def runs(df: DataFrame, key: str, order: str, reported: str) -> DataFrame:
    """(key, longest_on, longest_off, gaps): longest runs with and without report, and runs without one between reports.

    Each key has one row per period.
    """
    w = W.partitionBy(key)
    island = F.row_number().over(w.orderBy(order)) - F.row_number().over(W.partitionBy(key, reported).orderBy(order))
    first = F.min(F.when(F.col(reported), F.col(order))).over(w)
    last = F.max(F.when(F.col(reported), F.col(order))).over(w)
    marked = df.withColumns({"__island": island, "__first": first, "__last": last})
    parts = marked.groupBy(key, reported, "__island").agg(F.count("*").alias("n"), F.min(order).alias("a"), F.max(order).alias("b"), F.first("__first").alias("f"), F.first("__last").alias("l"))
    return parts.groupBy(key).agg(
        F.coalesce(F.max(F.when(F.col(reported), F.col("n"))), F.lit(0)).alias("longest_on"), F.coalesce(F.max(F.when(~F.col(reported), F.col("n"))), F.lit(0)).alias("longest_off"),
        F.count_if(~F.col(reported) & (F.col("a") > F.col("f")) & (F.col("b") < F.col("l"))).alias("gaps"),
    )


def composition_changes(facts: DataFrame, group: str, period: str, unit: str) -> DataFrame:
    """(group, changes): periods whose set of units differs from the previous period's."""
    sets = facts.groupBy(group, period).agg(F.sort_array(F.collect_set(unit)).alias("units"))
    before = F.lag("units").over(W.partitionBy(group).orderBy(period))
    return sets.withColumn("before", before).groupBy(group).agg(F.count_if(F.col("before").isNotNull() & (F.col("before") != F.col("units"))).alias("changes"))


def median_before(value: str, key: list[str], order: str, n: int) -> tuple[Column, Column]:
    """(median, count) of the n rows before."""
    w = W.partitionBy(*key).orderBy(order).rowsBetween(-n, -1)
    return F.percentile(value, F.lit(0.5)).over(w), F.count(value).over(w)


def incomplete_tail(df: DataFrame, key: list[str], order: str, passes: Column) -> Column:
    """Whether no row from here to the end passes: what was registered late."""
    return ~F.bool_or(F.coalesce(passes, F.lit(True))).over(W.partitionBy(*key).orderBy(F.desc(order)).rowsBetween(W.unboundedPreceding, 0))


def flag_late_weeks(df: DataFrame, key: list[str], order: str, value: str, share: float = 0.75, n: int = 8) -> DataFrame:
    """``df`` with ``late`` and ``completeness`` (value over the median of the n weeks before)."""
    median, count = median_before(value, key, order, n)
    at = df.withColumns({"__median": median, "__n": count})
    passes = (F.col("__n") < n) | (F.col(value) >= share * F.col("__median"))
    completeness = F.when(F.col("__n") == n, F.try_divide(F.col(value), F.col("__median")))
    return at.withColumns({"late": incomplete_tail(at, key, order, passes), "completeness": completeness}).drop("__median", "__n")


def flag_late_days(df: DataFrame, key: list[str], day: str, value: str, share: float = 0.5, n: int = 8) -> DataFrame:
    """``df`` with ``late``: a day under ``share`` of the median of the n same weekdays before, at the end only."""
    at = df.withColumn("__weekday", F.dayofweek(day))
    median, count = median_before(value, [*key, "__weekday"], day, n)
    at = at.withColumns({"__median": median, "__n": count})
    passes = (F.col("__n") < n) | (F.col(value) >= share * F.col("__median"))
    return at.withColumn("late", incomplete_tail(at, key, day, passes)).drop("__median", "__n", "__weekday")


def last_months(df: DataFrame, month: str, n: int) -> DataFrame:
    """Rows within n months of the table's last month."""
    number = F.year(month) * 12 + F.month(month)
    last = df.agg(F.max(number).alias("__last"))
    return df.crossJoin(F.broadcast(last)).where(number > F.col("__last") - n).drop("__last")


def segments(df: DataFrame, key: str, year: str, label: str) -> DataFrame:
    """(key, label, from_year, to_year): consecutive years with one label."""
    island = F.col(year) - F.row_number().over(W.partitionBy(key, label).orderBy(year))
    return df.withColumn("__i", island).groupBy(key, label, "__i").agg(F.min(year).alias("from_year"), F.max(year).alias("to_year")).drop("__i")
