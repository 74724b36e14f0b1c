"""The roles that the test tables play, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfold.functions import calendar
from tallyfold.sources import shared

Query = Callable[[SparkSession, str], DataFrame]


class Tables:
    """The tables of a folder as attributes."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self.made: dict[str, DataFrame] = {}

    def kept(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """A table that a query uses several times, and that is far smaller than its facts: made and written once."""
        if name not in self.made:
            self.made[name] = shared.kept(make(), name)
        return self.made[name]

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


class Section:
    """Collects queries with their SQL."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def __call__(self, sql: str | None = None) -> Callable[[Callable[[Tables], DataFrame]], Callable[[Tables], DataFrame]]:
        def keep(f: Callable[[Tables], DataFrame]):
            self.queries[f.__name__] = lambda spark, folder: f(Tables(spark, folder))
            if sql:
                self.sql[f.__name__] = sql
            return f

        return keep


def visits(t: Tables) -> DataFrame:
    """(day, facility, area, region, cause, total, order_id): daily facts by facility and cause."""
    return (
        t.lineitem.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey"))
        .join(t.nation, F.col("s_nationkey") == F.col("n_nationkey"))
        .select(
            F.to_date("l_shipdate").alias("day"), F.col("l_suppkey").alias("facility"), F.col("s_nationkey").alias("area"), F.col("n_regionkey").alias("region"),
            F.concat("l_returnflag", "l_linestatus").alias("cause"), F.col("l_quantity").cast("long").alias("total"), F.col("l_orderkey").alias("order_id"),
        )
    )


VISITS = """visits AS (SELECT CAST(l_shipdate AS DATE) AS day, l_suppkey AS facility, s_nationkey AS area, n_regionkey AS region,
    l_returnflag || l_linestatus AS cause, CAST(l_quantity AS BIGINT) AS total, l_orderkey AS order_id
    FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey)"""


def weekly_visits(t: Tables) -> DataFrame:
    """``visits`` with agency year and week."""
    return calendar.with_week(visits(t), "day")


def sql_fields(*columns: str) -> str:
    """The text that ``readers.row_hash`` hashes."""
    return " || ".join(f"coalesce(CAST(length(CAST({c} AS VARCHAR)) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), '-')" for c in columns)


def sql_start(year: str) -> str:
    return f"(make_date(CAST({year} AS BIGINT), 1, 4) - CAST(dayofweek(make_date(CAST({year} AS BIGINT), 1, 4)) AS INTEGER))"


def sql_week(day: str) -> str:
    y = f"year({day})"
    base = f"CASE WHEN {day} < {sql_start(y)} THEN {sql_start(y + ' - 1')} WHEN {day} >= {sql_start(y + ' + 1')} THEN {sql_start(y + ' + 1')} ELSE {sql_start(y)} END"
    return f"CAST((({day}) - ({base})) // 7 + 1 AS INTEGER)"


WEEKLY = f"""{VISITS}, weekly AS (SELECT *, CAST(year(day) AS INTEGER) AS year, {sql_week('day')} AS week FROM visits)"""

CALENDAR = f"""calendar AS (SELECT year, week, min(day) AS first_day, max(day) AS last_day, count(*) AS days FROM (
    SELECT CAST(d AS DATE) AS day, CAST(year(d) AS INTEGER) AS year, {sql_week('CAST(d AS DATE)')} AS week
    FROM (SELECT unnest(generate_series(min(CAST(l_shipdate AS DATE)), max(CAST(l_shipdate AS DATE)), INTERVAL 1 DAY)) AS d FROM lineitem)) GROUP BY year, week)"""

#: Weeks of the calendar that the facts cover from their first to their last day.
WHOLE = """whole AS (SELECT * FROM calendar WHERE (dayofweek(first_day) = 0 OR dayofyear(first_day) = 1) AND (dayofweek(last_day) = 6 OR (month(last_day) = 12 AND day(last_day) = 31)))"""

PANEL = f"""{WEEKLY}, {CALENDAR}, {WHOLE}, periods AS (SELECT year, week, CAST(row_number() OVER (ORDER BY year, week) - 1 AS INTEGER) AS t FROM whole WHERE week <= 52),
sums AS (SELECT area, year, week, sum(total) AS y FROM weekly GROUP BY ALL),
leaves AS (SELECT n_nationkey AS area, n_regionkey AS region, t, p.year, p.week, CAST(coalesce(y, 0) AS BIGINT) AS y
    FROM nation CROSS JOIN periods p LEFT JOIN sums s ON s.area = n_nationkey AND s.year = p.year AND s.week = p.week),
panel AS (SELECT 'A' || lpad(CAST(area AS VARCHAR), 2, '0') AS series_id, 'leaf' AS level, region AS service, t, year, week, y FROM leaves
    UNION ALL SELECT 'S' || CAST(region AS VARCHAR), 'service', region, t, year, week, CAST(sum(y) AS BIGINT) FROM leaves GROUP BY region, t, year, week
    UNION ALL SELECT 'TOTAL', 'total', NULL, t, year, week, CAST(sum(y) AS BIGINT) FROM leaves GROUP BY t, year, week)"""


def calendar_table(t: Tables) -> DataFrame:
    """The agency weeks from the first to the last day of the facts."""
    day = F.to_date("l_shipdate")
    span = t.lineitem.agg(F.min(day).alias("a"), F.max(day).alias("b"))
    return t.kept("calendar", lambda: calendar.weeks_of(span.select(F.explode(F.sequence("a", "b")).alias("day"))))


def area_weeks(t: Tables) -> DataFrame:
    """(area, year, week, y): weekly sums per area. Facts are added up by day first, so weeks are found for days, not facts."""
    by_day = visits(t).groupBy("area", "day").agg(F.sum("total").alias("total"))
    return t.kept("area-weeks", lambda: calendar.with_week(by_day, "day").groupBy("area", "year", "week").agg(F.sum("total").alias("y")))


#: Years of one row of ``area_reporters``, a number each.
_YEARS = 8


def area_reporters(t: Tables) -> DataFrame:
    """(area, region, year, week, n): how many facilities of an area have facts in a week.

    The weeks of a facility's year, 53 at most, are the bits of one number, and eight years are the columns of one row,
    so that facts shrink to about a row for each facility before they are shuffled or joined.
    """
    # one row; null if no fact has a day
    first = calendar_table(t).agg(F.min("year")).first()[0] or 0
    facts = calendar.with_week(t.lineitem.select(F.col("l_suppkey").alias("facility"), F.to_date("l_shipdate").alias("day")), "day")
    since = F.col("year") - first
    facts = facts.select("facility", F.floor(since / _YEARS).cast("int").alias("block"), F.pmod(since, F.lit(_YEARS)).alias("place"), F.expr("shiftleft(1L, week)").alias("bit"))
    by_place = (F.bit_or(F.when(F.col("place") == k, F.col("bit")).otherwise(F.lit(0).cast("long"))).alias(f"weeks_{k}") for k in range(_YEARS))
    weeks = facts.groupBy("facility", "block").agg(*by_place)
    areas = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("facility"), F.col("s_nationkey").alias("area"), F.col("n_regionkey").alias("region")).distinct()
    # a row per facility and eight years meets one per facility
    joined = weeks.join(areas.hint("shuffle_hash"), "facility")
    years = F.array(*(F.struct((first + _YEARS * F.col("block") + k).cast("int").alias("year"), F.col(f"weeks_{k}").alias("weeks")) for k in range(_YEARS)))
    by_area = joined.select("area", "region", F.explode(years).alias("r")).select("area", "region", "r.*").where("weeks <> 0")
    by_area = by_area.withColumn("week", F.explode(F.sequence(F.lit(1), F.lit(53)))).where("getbit(weeks, week) = 1")
    return by_area.groupBy("area", "region", "year", "week").agg(F.count("*").alias("n"))


def panel(t: Tables) -> DataFrame:
    """(series_id, level, service, t, year, week, y): weekly sums per area, region and in total.

    All weeks of the facts but week 53 and a first or last week that they cover in part.
    """
    from tallyfold.operators import panels

    leaves = t.nation.select(F.col("n_nationkey").alias("area"), F.col("n_regionkey").alias("service"))
    leaves = leaves.withColumn("series_id", F.concat(F.lit("A"), F.lpad(F.col("area").cast("string"), 2, "0")))
    return t.kept("panel", lambda: panels.hierarchical(area_weeks(t), leaves, calendar_table(t).where(calendar.whole(F.col("first_day"), F.col("last_day"))), unit="area", value="y"))
