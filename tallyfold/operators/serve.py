"""Answers to the questions of a service, as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def summary(panel: DataFrame, forecast: DataFrame, names: DataFrame, window: int = 4, threshold: float = 10.0) -> DataFrame:
    """(names, recent, ahead, change, label, outside): recent mean against the mean of the next periods."""
    last = panel.agg(F.max("t").alias("m"))
    recent = panel.crossJoin(F.broadcast(last)).where(F.col("t") > F.col("m") - window).groupBy("series_id").agg(F.avg("y").alias("recent"))
    ahead = forecast.where(F.col("horizon") <= window).groupBy("series_id").agg(F.avg("y_pred").alias("ahead"), F.avg("lo").alias("lo"), F.avg("hi").alias("hi"))
    out = names.join(recent, "series_id", "left").join(ahead, "series_id", "left")
    change = 100.0 * (F.try_divide("ahead", "recent") - 1)
    label = F.when(F.col("ahead").isNull(), "no forecast").when(change > threshold, "rise").when(change < -threshold, "fall").otherwise("stable")
    return out.withColumns({"change": change, "label": label, "outside": (F.col("recent") < F.col("lo")) | (F.col("recent") > F.col("hi"))}).drop("lo", "hi")


def series(panel: DataFrame, forecast: DataFrame, periods: int) -> DataFrame:
    """(series_id, t, kind, value, lo, hi): the last periods of the history, and the forecast."""
    last = panel.agg(F.max("t").alias("m"))
    history = panel.crossJoin(F.broadcast(last)).where(F.col("t") > F.col("m") - periods).select("series_id", "t", F.lit("history").alias("kind"), F.col("y").cast("double").alias("value"))
    return history.unionByName(forecast.select("series_id", "t", F.lit("forecast").alias("kind"), F.col("y_pred").alias("value"), "lo", "hi"), allowMissingColumns=True)


def with_reasons(areas: DataFrame, forecast: DataFrame, reasons: DataFrame, otherwise: str) -> DataFrame:
    """All areas: whether they have a forecast, or why not."""
    made = forecast.select("series_id").distinct().withColumn("has_forecast", F.lit(True))
    out = areas.join(made, "series_id", "left").join(reasons, "series_id", "left").withColumn("has_forecast", F.coalesce("has_forecast", F.lit(False)))
    return out.withColumn("reason", F.when(~F.col("has_forecast"), F.coalesce("reason", F.lit(otherwise))))


def forecasts(forecast: DataFrame, level: str | None = None, horizon: int | None = None) -> DataFrame:
    if level is not None:
        forecast = forecast.where(F.col("level") == level)
    return forecast if horizon is None else forecast.where(F.col("horizon") == horizon)


def current_period(weekly: DataFrame, value: str) -> DataFrame:
    """The newest regular week with under seven days, which is kept apart from the history."""
    w = weekly.where("week <= 52").groupBy("year", "week").agg(F.count_distinct("day").alias("days"), F.sum(value).alias(value)).where("days < 7")
    return w.orderBy(F.desc("year"), F.desc("week")).limit(1)


def beds(rows: DataFrame, area: str, unit: str) -> DataFrame:
    """(area, beds, hospitals, declaring, ranked): beds are null where none declares any; units from the largest down."""
    listed = F.sort_array(F.collect_list(F.when(F.col("beds").isNotNull(), F.struct((-F.col("beds")).alias("__order"), F.col(unit), F.col("beds")))))
    return rows.groupBy(area).agg(F.sum("beds").alias("beds"), F.count("*").alias("hospitals"), F.count("beds").alias("declaring"), listed.alias("ranked"))


def facility_summary(monthly: DataFrame, facilities: DataFrame) -> DataFrame:
    """(facility, recent, before, change, reason): the last three months against the same months a year ago."""
    last = monthly.agg(F.max("month").alias("m"))
    at = monthly.crossJoin(F.broadcast(last))
    recent = F.avg(F.when(F.col("month") > F.add_months("m", -3), F.col("n")))
    before = F.avg(F.when((F.col("month") <= F.add_months("m", -12)) & (F.col("month") > F.add_months("m", -15)), F.col("n")))
    out = facilities.join(at.groupBy("facility").agg(recent.alias("recent"), before.alias("before")), "facility", "left")
    reason = F.when(F.col("recent").isNull(), "no recent reports").when(F.col("before").isNull(), "no base")
    return out.withColumns({"change": 100.0 * (F.try_divide("recent", "before") - 1), "reason": reason})


def detail(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """(key, rows): each key's rows in order, as an array of structs."""
    return rows.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(order, value))).alias("rows"))


def trailing_rate(events: DataFrame, people: DataFrame, area: str, day: str, days: int = 364) -> DataFrame:
    """(area, n, rate): events of the last days, per 100,000 people and year."""
    last = events.agg(F.max(day).alias("m"))
    n = events.crossJoin(F.broadcast(last)).where(F.col(day) > F.date_sub("m", days)).groupBy(area).agg(F.count("*").alias("n"))
    return n.join(people, area).select(area, "n", (F.col("n") * 100000.0 / F.col("people") * F.lit(365.25 / days)).alias("rate"))


def shares(rows: DataFrame, by: list[str], category: str) -> DataFrame:
    n = rows.groupBy(*by, category).agg(F.count("*").alias("n"))
    return n.withColumn("share", F.try_divide("n", F.sum("n").over(W.partitionBy(*by))))


def characterise(rows: DataFrame, chosen: DataFrame, keys: list[str], area: str, category: str, value: str) -> DataFrame:
    """(area, category, value, whole) over the chosen periods; ``whole`` is what the categories must add up to."""
    kept = rows.join(chosen.hint("merge"), keys, "left_semi")
    sums = kept.groupBy(area, category).agg(F.sum(value).alias(value))
    return sums.withColumn("whole", F.sum(value).over(W.partitionBy(area)))


def largest_remainder(weights: DataFrame, group: str, category: str, weight: str, amount: int) -> DataFrame:
    """(group, category, allocated): whole numbers that add up to ``amount``, by shares; exact, without dividing."""
    w = W.partitionBy(group)
    at = weights.withColumn("__total", F.sum(weight).over(w)).withColumn("__x", F.col(weight) * amount)
    at = at.withColumn("__rest", F.col("__x") % F.col("__total")).withColumn("__base", ((F.col("__x") - F.col("__rest")) / F.col("__total")).cast("long"))
    at = at.withColumns({"__open": amount - F.sum("__base").over(w), "__k": F.row_number().over(w.orderBy(F.desc("__rest"), category))})
    return at.select(group, category, (F.col("__base") + (F.col("__k") <= F.col("__open")).cast("long")).alias("allocated"))


def sparse_card(mart: DataFrame, key: str, day: str) -> DataFrame:
    """(key, last_year, cutoff, late_weeks, mean): counts of the last 52 weeks, the last complete week, and late ones."""
    last = mart.agg(F.max(day).alias("m"))
    at = mart.crossJoin(F.broadcast(last))
    return at.groupBy(key).agg(
        F.sum(F.when(F.col(day) > F.date_sub("m", 364), F.col("n"))).alias("last_year"), F.max(F.when(~F.col("late"), F.col(day))).alias("cutoff"), F.count_if("late").alias("late_weeks"), F.avg("n").alias("mean")
    )
