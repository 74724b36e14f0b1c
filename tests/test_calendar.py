import datetime as dt

from pyspark.sql import functions as F

from tallyfold.functions import calendar


def test_agency_week_of_known_days(spark):
    days = {"2025-12-28": (2025, 53), "2026-01-03": (2026, 53), "2026-01-04": (2026, 1)}
    df = spark.createDataFrame([(d,) for d in days], "d string").withColumn("day", F.to_date("d"))
    got = {r.d: (r.year, r.week) for r in calendar.with_week(df, "day").collect()}
    assert got == days


def test_days_of_first_weeks(spark):
    got = {(r.year, r.week): r.days for r in calendar.weeks(spark, "2023-12-01", "2025-02-28").collect()}
    assert got[(2025, 1)] == 4 and got[(2024, 52)] == 7


def test_easter_and_seasons(spark):
    df = spark.createDataFrame([(2000,), (2019,), (2024,), (2049,)], "year int")
    got = {r.year: r.e for r in df.select("year", calendar.easter(F.col("year")).alias("e")).collect()}
    assert got == {2000: dt.date(2000, 4, 23), 2019: dt.date(2019, 4, 21), 2024: dt.date(2024, 3, 31), 2049: dt.date(2049, 4, 18)}
    s = df.where("year = 2024").select(*(calendar.season_day(F.col("year"), m).alias(f"m{m}") for m in (3, 6, 9, 12))).first()
    assert tuple(s) == (dt.date(2024, 3, 20), dt.date(2024, 6, 20), dt.date(2024, 9, 22), dt.date(2024, 12, 21))


def test_next_regular_week_wraps(spark):
    df = spark.createDataFrame([(2024, 51)], "year int, week int")
    y, w = calendar.next_regular(F.col("year"), F.col("week"), 3)
    assert tuple(df.select(y, w).first()) == (2025, 2)


def test_events_have_a_first_and_a_last_day(spark):
    years = spark.createDataFrame([(2024,), (2025,)], "year int")
    got = {(r.year, r.event): (r.from_day, r.to_day) for r in calendar.holidays(years).collect()}
    assert got[2025, "new_year"] == (dt.date(2024, 12, 31), dt.date(2025, 1, 1)) and got[2024, "holy_week"] == (dt.date(2024, 3, 29), dt.date(2024, 3, 31))
    assert got[2024, "fathers_day"] == (dt.date(2024, 6, 16),) * 2 and got[2024, "mothers_day"] == (dt.date(2024, 5, 12),) * 2 and len(got) == 14
    seasons = {(r.year, r.season): (r.from_day, r.to_day) for r in calendar.seasons(years).collect()}
    # the solstice of June 2025 is on the 21st at 02:42 UTC, still the 20th in Santiago
    assert seasons[2025, "winter"][0] == dt.date(2025, 6, 20) and seasons[2025, "autumn"][1] == dt.date(2025, 6, 19)
    assert seasons[2024, "summer"][1] == seasons_start(seasons[2025, "autumn"])


def seasons_start(season):
    return season[0] - dt.timedelta(days=1)
