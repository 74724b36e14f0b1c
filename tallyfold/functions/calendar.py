"""Agency weeks, holidays and seasons as column expressions.

An agency week runs from Sunday to Saturday; week 1 holds 4 January. Weeks carry the calendar year of the day, so
that week 53, and days of week 1 that fall in December, are fragments.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def week_one(year: Column) -> Column:
    """The Sunday on or before 4 January."""
    fourth = F.make_date(year, F.lit(1), F.lit(4))
    return F.date_sub(fourth, F.dayofweek(fourth) - 1)


def agency_week(day: Column) -> Column:
    year = F.year(day)
    base = F.when(day < week_one(year), week_one(year - 1)).when(day >= week_one(year + 1), week_one(year + 1)).otherwise(week_one(year))
    return (F.floor(F.datediff(day, base) / 7) + 1).cast("int")


def with_week(df: DataFrame, day: str) -> DataFrame:
    """``df`` with ``year`` and ``week`` of column ``day``."""
    return df.withColumns({"year": F.year(day), "week": agency_week(F.col(day))})


def days(spark: SparkSession, first: str, last: str) -> DataFrame:
    return spark.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("day"))


def weeks(spark: SparkSession, first: str, last: str) -> DataFrame:
    """(year, week, first_day, last_day, days), one row per agency week of the range."""
    return weeks_of(days(spark, first, last))


def weeks_of(dates: DataFrame) -> DataFrame:
    """The agency weeks of a table of days (day)."""
    return with_week(dates, "day").groupBy("year", "week").agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.count("*").alias("days"))


def closed(last_day: Column) -> Column:
    """Whether a week that ends on this day is over: on a Saturday or on 31 December."""
    return (F.dayofweek(last_day) == 7) | ((F.month(last_day) == 12) & (F.dayofmonth(last_day) == 31))


def whole(first_day: Column, last_day: Column) -> Column:
    """Whether the days of a week that are known run from its start to its end."""
    return ((F.dayofweek(first_day) == 1) | (F.dayofyear(first_day) == 1)) & closed(last_day)


def next_regular(year: Column, week: Column, steps: Column | int = 1) -> tuple[Column, Column]:
    """(year, week) some steps on, in years of 52 weeks."""
    at = week - 1 + steps
    return (year + F.floor(at / 52)).cast("int"), (F.pmod(at, F.lit(52)) + 1).cast("int")


def year_days(year: Column) -> Column:
    return F.dayofyear(F.make_date(year, F.lit(12), F.lit(31)))


def fourier(week: Column, harmonics: int, period: int = 52) -> dict[str, Column]:
    out = {}
    for k in range(1, harmonics + 1):
        out |= {f"sin_{k}": F.sin(2 * math.pi * k * week / period), f"cos_{k}": F.cos(2 * math.pi * k * week / period)}
    return out


def easter(year: Column) -> Column:
    """Easter Sunday in the Gregorian calendar."""
    div = lambda a, b: F.floor(a / b).cast("int")
    golden, century = year % 19, div(year, 100)
    epact = (century - div(century, 4) - div(8 * century + 13, 25) + 19 * golden + 15) % 30
    epact = epact - F.when((epact == 29) | ((epact == 28) & (golden > 10)), 1).otherwise(0)
    weekday = (year + div(year, 4) + epact + 2 - century + div(century, 4)) % 7
    ahead = epact - weekday
    march = F.make_date(year, F.lit(3), F.lit(1))
    return F.date_add(march, (ahead + 27).cast("int"))


def nth_weekday(year: Column, month: int, weekday: int, n: int) -> Column:
    """The n-th ``weekday`` (1 Sunday to 7 Saturday) of a month."""
    first = F.make_date(year, F.lit(month), F.lit(1))
    return F.date_add(first, (F.pmod(F.lit(weekday) - F.dayofweek(first), F.lit(7)) + 7 * (n - 1)).cast("int"))


#: Name, month and day of the first day (of the year before where negative), month and day of the last.
FIXED_HOLIDAYS = (("new_year", -12, 31, 1, 1), ("national_days", 9, 18, 9, 19), ("all_saints", 10, 31, 11, 1), ("christmas", 12, 24, 12, 25))
#: Name, month and number of the Sunday.
SUNDAYS = (("mothers_day", 5, 2), ("fathers_day", 6, 3))


def holidays(years: DataFrame) -> DataFrame:
    """(year, event, from_day, to_day) for each row of ``years`` (year); Easter runs from Friday to Sunday."""
    y = F.col("year")
    entry = lambda name, a, b: F.struct(F.lit(name).alias("event"), a.alias("from_day"), b.alias("to_day"))
    fixed = [entry(n, F.make_date(y - (1 if m < 0 else 0), F.lit(abs(m)), F.lit(d)), F.make_date(y, F.lit(m2), F.lit(d2))) for n, m, d, m2, d2 in FIXED_HOLIDAYS]
    sundays = [entry(n, nth_weekday(y, m, 1, k), nth_weekday(y, m, 1, k)) for n, m, k in SUNDAYS]
    week = entry("holy_week", F.date_sub(easter(y), 2), easter(y))
    return years.select("year", F.explode(F.array(*fixed, *sundays, week)).alias("e")).select("year", "e.*")


#: Fixed values of the published series for the mean instants of equinoxes and solstices, years 1000 to 3000:
#: month to coefficients of powers of (year - 2000) / 1000, in Julian days.
SEASON_MEANS = {
    3: (2451623.80984, 365242.37404, 0.05169, -0.00411, -0.00057),
    6: (2451716.56767, 365241.62603, 0.00325, 0.00888, -0.00030),
    9: (2451810.21715, 365242.01767, -0.11575, 0.00337, 0.00078),
    12: (2451900.05952, 365242.74049, -0.06223, -0.00823, 0.00032),
}
#: Amplitude, phase and rate (degrees) of the periodic terms of that series.
SEASON_TERMS = (
    (485, 324.96, 1934.136), (203, 337.23, 32964.467), (199, 342.08, 20.186), (182, 27.85, 445267.112), (156, 73.14, 45036.886), (136, 171.52, 22518.443),
    (77, 222.54, 65928.934), (74, 296.72, 3034.906), (70, 243.58, 9037.513), (58, 119.81, 33718.147), (52, 297.17, 150.678), (50, 21.02, 2281.226),
    (45, 247.54, 29929.562), (44, 325.15, 31555.956), (29, 60.93, 4443.417), (18, 155.12, 67555.328), (17, 288.79, 4562.452), (16, 198.04, 62894.029),
    (14, 199.76, 31436.921), (12, 95.39, 14577.848), (12, 287.11, 31931.756), (12, 320.81, 34777.259), (9, 227.73, 1222.114), (8, 15.45, 16859.074),
)


def season_instant(year: Column, month: int) -> Column:
    """Julian day of the equinox or solstice of a month (3, 6, 9, 12)."""
    m = (year - 2000) / 1000.0
    mean = sum((F.lit(c) * F.pow(m, F.lit(k)) for k, c in enumerate(SEASON_MEANS[month])), F.lit(0.0))
    centuries = (mean - 2451545.0) / 36525.0
    angle = F.radians(35999.373 * centuries - 2.47)
    spread = 1 + 0.0334 * F.cos(angle) + 0.0007 * F.cos(2 * angle)
    terms = sum((F.lit(float(a)) * F.cos(F.radians(F.lit(b) + F.lit(c) * centuries)) for a, b, c in SEASON_TERMS), F.lit(0.0))
    return mean + 0.00001 * terms / spread


#: Seconds by which the clock of the series is ahead of universal time, by powers of (year - 2000).
CLOCK_AHEAD = (62.92, 0.32217, 0.005589)
#: The season that begins at the equinox or solstice of a month, in the south.
SOUTHERN = {3: "autumn", 6: "winter", 9: "spring", 12: "summer"}


def season_day(year: Column, month: int, zone: str = "UTC") -> Column:
    """Local date of the season's start."""
    at = year + 0.5 - 2000
    ahead = sum((F.lit(c) * F.pow(at, F.lit(k)) for k, c in enumerate(CLOCK_AHEAD)), F.lit(0.0))
    seconds = (season_instant(year, month) - 2440587.5) * 86400 - ahead
    return F.to_date(F.from_utc_timestamp(F.timestamp_seconds(F.floor(seconds)), zone))


def seasons(years: DataFrame, zone: str = "America/Santiago") -> DataFrame:
    """(year, season, from_day, to_day) of the seasons that begin in each row of ``years``; a season ends the day before the next."""
    y, months = F.col("year"), sorted(SOUTHERN)
    starts = [season_day(y, m, zone) for m in months] + [season_day(y + 1, months[0], zone)]
    entry = lambda k, m: F.struct(F.lit(SOUTHERN[m]).alias("season"), starts[k].alias("from_day"), F.date_sub(starts[k + 1], 1).alias("to_day"))
    return years.select("year", F.explode(F.array(*(entry(k, m) for k, m in enumerate(months)))).alias("s")).select("year", "s.*")
