"""Series panels: one regular grid for all series, levels as sums of leaves, supervised rows without leakage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyfold.functions import calendar

SEASON = 52


def time_index(periods: DataFrame, order: list[str]) -> DataFrame:
    """``periods`` with ``t``, a dense index from 0. There is one row per period, so one task orders them."""
    return periods.withColumn("t", F.row_number().over(W.orderBy(*order)) - 1)


def hierarchical(sums: DataFrame, leaves: DataFrame, weeks: DataFrame, unit: str, value: str) -> DataFrame:
    """(series_id, level, service, t, year, week, y): leaves, services and the total on one grid without week 53.

    ``leaves`` has one row (unit, series_id, service) per leaf; a leaf without facts in a week has a true 0.
    Aggregates are sums of leaves, taken before any join, so that the total is never a skewed key.
    """
    periods = time_index(weeks.where(F.col("week") <= SEASON).select("year", "week"), ["year", "week"])
    grid = leaves.crossJoin(F.broadcast(periods)).join(sums.hint("merge"), [unit, "year", "week"], "left").withColumn("y", F.coalesce(value, F.lit(0)).cast("long"))
    level = lambda name, sid, service, df: df.select(sid.alias("series_id"), F.lit(name).alias("level"), service.alias("service"), "t", "year", "week", "y")
    by_service = grid.groupBy("service", "t", "year", "week").agg(F.sum("y").alias("y"))
    total = grid.groupBy("t", "year", "week").agg(F.sum("y").alias("y"))
    out = level("leaf", F.col("series_id"), F.col("service"), grid)
    out = out.unionByName(level("service", F.concat(F.lit("S"), F.col("service").cast("string")), F.col("service"), by_service))
    return out.unionByName(level("total", F.lit("TOTAL"), F.lit(None).cast("int"), total))


def future_rows(panel: DataFrame, steps: int) -> DataFrame:
    """Marker rows after each series' last period: (series_id, level, service, t, year, week, horizon), y missing."""
    last = panel.groupBy("series_id", "level", "service").agg(F.max("t").alias("__t"), F.max_by("year", "t").alias("__y"), F.max_by("week", "t").alias("__w"))
    rows = last.select("*", F.explode(F.sequence(F.lit(1), F.lit(steps))).alias("horizon"))
    year, week = calendar.next_regular(F.col("__y"), F.col("__w"), F.col("horizon"))
    return rows.select("series_id", "level", "service", (F.col("__t") + F.col("horizon")).cast("int").alias("t"), year.alias("year"), week.alias("week"), F.lit(None).cast("long").alias("y"), "horizon")


def series_window():
    return W.partitionBy("series_id").orderBy("t")


def lag(k: int, value: str = "y") -> Column:
    return F.lag(value, k).over(series_window())


def rolling(h: int, width: int, value: str = "y") -> tuple[Column, Column]:
    """(mean, sample deviation) of ``width`` values that end at t - h; null until there are so many."""
    w = series_window().rowsBetween(-(h + width - 1), -h)
    full = F.count(value).over(w) == width
    return F.when(full, F.avg(value).over(w)), F.when(full, F.stddev_samp(value).over(w))


def supervised(panel: DataFrame, horizons: list[int], lags: int = 4, widths: tuple[int, ...] = (4, 13), harmonics: int = 2, covariates: tuple[str, ...] = ()) -> DataFrame:
    """One row per series, period and horizon with features that use nothing after t - horizon.

    Covariates, other columns of the panel, come with their last two values known at the origin. Rows without full
    history are left out; one shuffle by series serves all horizons.
    """
    parts = []
    for h in horizons:
        cols = {f"lag_{k}": lag(h + k) for k in range(lags)}
        cols["season"] = lag(SEASON)
        cols["year_change"] = lag(h) - lag(h + SEASON)
        for w in widths:
            cols[f"mean_{w}"], cols[f"sd_{w}"] = rolling(h, w)
        for c in covariates:
            cols |= {f"{c}_{k}": lag(h + k, c) for k in range(2)}
        parts.append(F.struct(F.lit(h).alias("horizon"), *(c.alias(n) for n, c in cols.items())))
    out = panel.withColumn("__r", F.array(*parts)).withColumn("__r", F.explode("__r")).select(*panel.columns, "__r.*")
    out = out.withColumns({**calendar.fourier(F.col("week"), harmonics), "early": (F.col("t") < 13).cast("int")})
    return out.dropna(subset=[n for n in feature_names(lags, widths, harmonics, covariates) if not n.startswith(("sin", "cos", "early"))])


def feature_names(lags: int = 4, widths: tuple[int, ...] = (4, 13), harmonics: int = 2, covariates: tuple[str, ...] = ()) -> list[str]:
    names = [f"lag_{k}" for k in range(lags)] + ["season", "year_change"] + [f"{n}_{w}" for w in widths for n in ("mean", "sd")] + [f"{c}_{k}" for c in covariates for k in range(2)]
    return names + [f"{n}_{k}" for k in range(1, harmonics + 1) for n in ("sin", "cos")] + ["early"]
