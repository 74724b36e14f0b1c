"""Capacity: saturation, stress, bed scenarios and their back-checks. Rows are (unit, month, occupied, available)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyfold.operators import windows

PRESSURE, SATURATION = 85.0, 90.0
#: Share of its beds that a unit may use, in percent: the target of a scenario, and of its tighter variant.
TARGET, TIGHT = 85, 90


def month_days() -> Column:
    return F.dayofmonth(F.last_day("month"))


def area_summary(rows: DataFrame, unit: str) -> DataFrame:
    """(unit, months, short, over, last_month, last_occupied, last_available, index) of the months with beds."""
    free = (F.col("available") - F.col("occupied")) / month_days()
    open_ = rows.where("available > 0")
    return open_.groupBy(unit).agg(
        F.count("*").alias("months"), F.count_if(free < 1).alias("short"), F.count_if(F.col("occupied") > F.col("available")).alias("over"), F.max("month").alias("last_month"),
        F.max_by("occupied", "month").alias("last_occupied"), F.max_by("available", "month").alias("last_available"), (100.0 * F.sum("occupied") / F.sum("available")).alias("index"),
    )


def stress_level(rows: DataFrame, unit: str, months: int = 12) -> DataFrame:
    """(unit, index, over, stress) over the last months of the table: ratio of sums, and months over capacity."""
    recent = windows.last_months(rows, "month", months).where("available > 0")
    out = recent.groupBy(unit).agg((100.0 * F.sum("occupied") / F.sum("available")).alias("index"), F.count_if(F.col("occupied") > F.col("available")).alias("over"))
    label = F.when(F.col("over") > 0, "over_capacity").when(F.col("index") >= SATURATION, "saturation").when(F.col("index") >= PRESSURE, "pressure").otherwise("slack")
    return out.withColumn("stress", label)


def _ceil_ratio(a: Column, b: Column) -> Column:
    """Smallest integer of at least a / b, for whole numbers, without dividing."""
    x = a + b - 1
    return ((x - x % b) / b).cast("long")


def bed_scenario(rows: DataFrame, unit: str, endowment: DataFrame, cutoff: str | Column, months: int = 12) -> DataFrame:
    """(unit, reason, target, target_tight, gap, increase): beds so that the peak daily load of the last months stays
    at ``TARGET`` percent; no figures but a reason where months are missing, closed or old.

    ``endowment`` has (unit, declared), declared beds or null. ``cutoff`` is a date, or one that follows from the unit.
    """
    number = F.year("month") * 12 + F.month("month")
    own = rows.withColumn("__n", number).withColumn("__last", F.max("__n").over(W.partitionBy(unit))).where(F.col("__n") > F.col("__last") - months)
    # the peak of occupied / days by whole numbers: compared on one denominator, the product of month lengths
    common = F.lit(28 * 29 * 30 * 31).cast("long")
    load = F.col("occupied") * (common / month_days()).cast("long")
    one = own.withColumn("__load", load).groupBy(unit).agg(
        F.count("*").alias("n"), F.count_distinct("month").alias("distinct"), F.max("__last").alias("last"), F.max("__load").alias("peak"),
        F.count_if(F.col("occupied").isNull() | F.col("available").isNull() | (F.col("occupied") < 0) | (F.col("available") <= 0)).alias("bad"), F.max_by(F.col("available") / month_days(), "month").alias("beds"),
    )
    day = F.lit(cutoff).cast("date") if isinstance(cutoff, str) else cutoff
    now = F.year(day) * 12 + F.month(day)
    reason = F.when((F.col("last") >= now) | (now - F.col("last") > 12), "not closed or old").when(F.col("n") != F.col("distinct"), "repeated months").when(F.col("n") != months, "missing months").when(F.col("bad") > 0, "incomplete or closed")
    at = one.join(endowment, unit, "left").withColumn("reason", reason)
    known = F.col("reason").isNull()
    at = at.withColumns({"target": F.when(known, _ceil_ratio(F.col("peak") * 100, common * TARGET)), "target_tight": F.when(known, _ceil_ratio(F.col("peak") * 100, common * TIGHT))})
    gap = F.when(known, F.greatest(F.col("target") - F.col("beds"), F.lit(0.0)))
    base = F.coalesce(F.col("declared").cast("double"), F.col("beds"))
    return at.select(unit, "reason", "target", "target_tight", gap.alias("gap"), F.when(known, F.greatest(F.ceil(F.col("target") - base), F.lit(0))).alias("increase"))


def scenario_check(rows: DataFrame, unit: str) -> DataFrame:
    """(unit, year, target, months, kept): the scenario of each past January from what was known then, and how many months of that year stayed under it.

    All Januaries are one job: a unit as it was known in a year is a unit of its own.
    """
    # a row for each year
    years = F.broadcast(rows.select(F.year("month").alias("year")).distinct())
    past = rows.join(years, F.col("month") < F.make_date("year", F.lit(1), F.lit(1))).withColumn("__then", F.struct(unit, "year"))
    none = past.select("__then").distinct().withColumn("declared", F.lit(None).cast("double"))
    made = bed_scenario(past, "__then", none, F.make_date(F.col("__then.year"), F.lit(1), F.lit(15))).where("reason is null").select(f"__then.{unit}", "__then.year", "target")
    later = rows.withColumn("year", F.year("month")).withColumn("load", F.col("occupied") / month_days())
    return made.join(later, [unit, "year"]).groupBy(unit, "year", "target").agg(F.count("*").alias("months"), F.count_if(F.col("load") <= F.col("target")).alias("kept"))


def endowment_backtest(rows: DataFrame, unit: str, endowment: DataFrame) -> DataFrame:
    """(estimate, n, exact, near, mae): the median and the largest monthly beds of a unit against those declared."""
    beds = F.col("available") / month_days()
    est = rows.where("available > 0").groupBy(unit).agg(F.percentile(beds, F.lit(0.5)).alias("median"), F.max(beds).alias("largest"))
    long = est.unpivot([unit], ["median", "largest"], "estimate", "beds").join(endowment.where("declared is not null"), unit)
    off = F.abs(F.bround("beds") - F.col("declared"))
    return long.groupBy("estimate").agg(F.count("*").alias("n"), F.count_if(off == 0).alias("exact"), F.count_if(off <= 1).alias("near"), F.avg(F.abs(F.col("beds") - F.col("declared"))).alias("mae"))


def over_occupied(rows: DataFrame, unit: str) -> DataFrame:
    """(unit, months, most): months with more occupied than available, and the largest index."""
    return rows.where("occupied > available and available > 0").groupBy(unit).agg(F.count("*").alias("months"), F.max(100.0 * F.col("occupied") / F.col("available")).alias("most"))


def quarter_tie(quarters: DataFrame, rows: DataFrame, unit: str) -> DataFrame:
    """(unit, n, ratio): median ratio of published quarter totals to the sums of the months."""
    sums = rows.groupBy(unit, F.year("month").alias("year"), F.quarter("month").alias("quarter")).agg(F.sum("available").alias("sum"))
    both = quarters.join(sums, [unit, "year", "quarter"])
    return both.groupBy(unit).agg(F.count("*").alias("n"), F.percentile(F.col("total") / F.col("sum"), F.lit(0.5)).alias("ratio"))


def occupancy_report(rows: DataFrame, unit: str) -> DataFrame:
    """(unit, first_month, last_month, published, missing, over, index): span, gaps and totals."""
    number = F.year("month") * 12 + F.month("month")
    return rows.groupBy(unit).agg(
        F.min("month").alias("first_month"), F.max("month").alias("last_month"), F.count_distinct("month").alias("published"),
        (F.max(number) - F.min(number) + 1 - F.count_distinct("month")).alias("missing"), F.count_if(F.col("occupied") > F.col("available")).alias("over"),
        F.when(F.sum("available") > 0, 100.0 * F.sum("occupied") / F.sum("available")).alias("index"),
    )
