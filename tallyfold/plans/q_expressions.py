"""2.2 projections and expressions, and 2.6 calendar."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyfold.functions import calendar, cleaning
from tallyfold.plans.testbed import CALENDAR, PANEL, VISITS, Section, Tables, calendar_table, panel, sql_week, visits

section = Section()


@section("SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_type || ' X' END AS kind FROM part")
def b1_clean_text(t: Tables) -> DataFrame:
    messy = F.when(F.col("p_partkey") % 5 == 0, F.element_at(F.array(F.lit(""), F.lit("nan"), F.lit(" None "), F.lit("No Aplica")), (F.col("p_partkey") % 4 + 1).cast("int"))).otherwise(F.concat(F.lit("  "), "p_type", F.lit("   X **")))
    return t.part.select("p_partkey", cleaning.clean_text(messy).alias("kind"))


@section("SELECT c_custkey, CASE WHEN c_custkey % 10 <> 0 THEN c_acctbal END AS balance FROM customer")
def b2_comma_number(t: Tables) -> DataFrame:
    text = F.when(F.col("c_custkey") % 10 == 0, "NaN").otherwise(F.regexp_replace(F.col("c_acctbal").cast("decimal(12,2)").cast("string"), r"\.", ","))
    return t.customer.select("c_custkey", cleaning.comma_number(text).alias("balance"))


@section("SELECT n_nationkey, lpad(CAST(n_nationkey AS VARCHAR), 5, '0') AS code, CASE WHEN n_nationkey * 9999 < 100000 THEN lpad(CAST(n_nationkey * 9999 AS VARCHAR), 5, '0') END AS wide FROM nation")
def b3_pad_code(t: Tables) -> DataFrame:
    key = F.col("n_nationkey")
    return t.nation.select("n_nationkey", cleaning.pad_code(key.cast("string"), 5).alias("code"), cleaning.pad_code((key * 9999).cast("string"), 5).alias("wide"))


@section("SELECT n_nationkey, n_nationkey = 7 AS is_seven FROM nation")
def b4_same_code(t: Tables) -> DataFrame:
    k = F.col("n_nationkey")
    text = F.when(k % 3 == 0, k.cast("string")).when(k % 3 == 1, F.concat(F.lit("0"), k.cast("string"))).otherwise(F.concat(k.cast("string"), F.lit(".0")))
    return t.nation.select("n_nationkey", cleaning.same_code(text, "07").alias("is_seven"))


@section("SELECT count(*) AS n, sum(CAST(l_quantity AS BIGINT)) AS total FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size <= 5)")
def b5_catalogue_filter(t: Tables) -> DataFrame:
    catalogue = t.part.where("p_size <= 5").select(F.col("p_partkey").alias("l_partkey"))
    return t.lineitem.join(catalogue, "l_partkey", "left_semi").agg(F.count("*").alias("n"), F.sum(F.col("l_quantity").cast("long")).alias("total"))


@section("SELECT p_type, count(*) AS n, CAST(sum(CASE WHEN regexp_matches(p_type, '^(PROMO|ECON)') <> (p_type IN ('PROMO', 'ECONOMY')) THEN 1 ELSE 0 END) AS BIGINT) AS mismatches FROM part GROUP BY 1")
def b6_case_definition(t: Tables) -> DataFrame:
    by_code, by_group = F.col("p_type").rlike("^(PROMO|ECON)"), F.col("p_type").isin("PROMO", "ECONOMY")
    return t.part.groupBy("p_type").agg(F.count("*").alias("n"), F.count_if(~by_code.eqNullSafe(by_group)).alias("mismatches"))


@section("SELECT p_partkey, CASE WHEN p_type LIKE '%Y' THEN 'core' WHEN p_type LIKE '%M' THEN 'medium' ELSE 'other' END AS kind FROM part")
def b7_type_by_suffix(t: Tables) -> DataFrame:
    text = F.lower(F.trim("p_type"))
    return t.part.select("p_partkey", cleaning.first_label([(text.rlike("y$"), "core"), (text.rlike("m$"), "medium")], "other").alias("kind"))


@section("""WITH m(old, new) AS (VALUES ('1-URGENT', 'high'), ('2-HIGH', 'high'), ('3-MEDIUM', 'mid'), ('5-LOW', 'low'))
    SELECT coalesce(new, 'no rule') AS harmonised, count(*) AS n FROM orders LEFT JOIN m ON o_orderpriority = old GROUP BY 1""")
def b8_harmonise(t: Tables) -> DataFrame:
    rules = t.spark.createDataFrame([("1-URGENT", "high"), ("2-HIGH", "high"), ("3-MEDIUM", "mid"), ("5-LOW", "low")], "o_orderpriority string, new string")
    return t.orders.join(F.broadcast(rules), "o_orderpriority", "left").groupBy(F.coalesce("new", F.lit("no rule")).alias("harmonised")).agg(F.count("*").alias("n"))


STAYS = "stays AS (SELECT o_orderkey, o_custkey, CAST(o_orderdate AS DATE) AS day, o_orderpriority, CAST(greatest(date_diff('day', CAST(o_orderdate AS DATE), max(CAST(l_shipdate AS DATE))), 1) AS INTEGER) AS days FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey, o_custkey, o_orderdate, o_orderpriority)"


def stays(t: Tables) -> DataFrame:
    """(o_orderkey, o_custkey, day, o_orderpriority, days): discharges, with days until the last shipping."""
    last = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max(F.to_date("l_shipdate")).alias("last"))
    return t.orders.join(last, "o_orderkey").select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("day"), "o_orderpriority", F.greatest(F.datediff("last", F.to_date("o_orderdate")), F.lit(1)).alias("days"))


@section(f"WITH {STAYS} SELECT o_orderkey, least(days, 365) AS capped, days > 365 AS over FROM stays")
def b9_cap_and_flag(t: Tables) -> DataFrame:
    return stays(t).select("o_orderkey", F.least("days", F.lit(365)).alias("capped"), (F.col("days") > 365).alias("over"))


@section("SELECT n_nationkey, CASE WHEN n_nationkey % 4 <> 0 THEN n_regionkey = 3 END AS resident FROM nation")
def b10_three_valued_flag(t: Tables) -> DataFrame:
    return t.nation.select("n_nationkey", (F.when(F.col("n_nationkey") % 4 != 0, F.col("n_regionkey")) == 3).alias("resident"))


BLOCKS = [(1, 9, "A"), (10, 24, "B"), (25, 50, "C")]


@section("WITH b(lo, hi, block) AS (VALUES (1, 9, 'A'), (10, 24, 'B'), (25, 50, 'C')) SELECT p_partkey, block FROM part LEFT JOIN b ON p_size BETWEEN lo AND hi")
def b11_range_lookup(t: Tables) -> DataFrame:
    blocks = t.spark.createDataFrame(BLOCKS, "lo int, hi int, block string")
    return t.part.join(F.broadcast(blocks), F.col("p_size").between(F.col("lo"), F.col("hi")), "left").select("p_partkey", "block")


@section("""SELECT p_partkey, CASE WHEN u = 1 THEN CASE WHEN q > 120 THEN 'unknown' WHEN q < 15 THEN '00-14' WHEN q < 30 THEN '15-29' WHEN q < 45 THEN '30-44' WHEN q < 65 THEN '45-64' ELSE '65+' END
    WHEN (u = 2 AND q <= 11) OR (u = 3 AND q <= 30) OR (u = 4 AND q <= 23) THEN '00-14' ELSE 'unknown' END AS band FROM (SELECT p_partkey, p_partkey % 5 + 1 AS u, p_size AS q FROM part)""")
def b12_age_band(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", cleaning.age_band(F.col("p_partkey") % 5 + 1, F.col("p_size")).alias("band"))


@section(f"""WITH {VISITS}, s AS (SELECT facility, count(DISTINCT day) AS days, sum(total) AS total FROM visits GROUP BY 1)
    SELECT s_suppkey, CASE WHEN days IS NULL THEN 'no activity' WHEN days < 420 THEN 'few days' WHEN total < 15000 THEN 'low volume' ELSE 'kept' END AS status FROM supplier LEFT JOIN s ON facility = s_suppkey""")
def b13_ordered_reason(t: Tables) -> DataFrame:
    activity = visits(t).groupBy(F.col("facility").alias("s_suppkey")).agg(F.count_distinct("day").alias("days"), F.sum("total").alias("total"))
    label = cleaning.first_label([(F.col("days").isNull(), "no activity"), (F.col("days") < 420, "few days"), (F.col("total") < 15000, "low volume")], "kept")
    return t.supplier.join(activity, "s_suppkey", "left").select("s_suppkey", label.alias("status"))


@section("""SELECT o_orderkey, array_to_string(list_filter([CASE WHEN o_totalprice > 400000 THEN 'high_price' END, CASE WHEN o_orderstatus = 'P' THEN 'pending' END, CASE WHEN year(o_orderdate) < 1996 THEN 'old' END], lambda x: x IS NOT NULL), ',') AS tags FROM orders""")
def b14_exception_array(t: Tables) -> DataFrame:
    found = cleaning.tags((F.col("o_totalprice") > 400000, "high_price"), (F.col("o_orderstatus") == "P", "pending"), (F.year("o_orderdate") < 1996, "old"))
    return t.orders.select("o_orderkey", F.array_join(found, ",").alias("tags"))


@section("SELECT l_suppkey, CASE WHEN d > 0 THEN n / d END AS ratio FROM (SELECT l_suppkey, CAST(sum(CASE WHEN l_returnflag = 'A' THEN l_quantity ELSE 0 END) AS DOUBLE) AS n, CAST(sum(CASE WHEN l_suppkey % 9 = 0 THEN 0 ELSE l_quantity END) AS DOUBLE) AS d FROM lineitem GROUP BY 1)")
def b15_ratio(t: Tables) -> DataFrame:
    sums = t.lineitem.groupBy("l_suppkey").agg(F.sum(F.when(F.col("l_returnflag") == "A", F.col("l_quantity")).otherwise(0)).alias("n"), F.sum(F.when(F.col("l_suppkey") % 9 == 0, 0).otherwise(F.col("l_quantity"))).alias("d"))
    return sums.select("l_suppkey", cleaning.ratio(F.col("n"), F.col("d")).alias("ratio"))


@section("""SELECT c_nationkey AS area, n * 10000.0::DOUBLE / people AS rate FROM (SELECT c_nationkey, count(*) AS people FROM customer GROUP BY 1) JOIN (SELECT c_nationkey AS k, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1) ON k = c_nationkey""")
def b16_rate(t: Tables) -> DataFrame:
    people = t.customer.groupBy(F.col("c_nationkey").alias("area")).agg(F.count("*").alias("people"))
    events = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_nationkey").alias("area")).agg(F.count("*").alias("n"))
    return people.join(events, "area").select("area", (F.col("n") * 10000.0 / F.col("people")).alias("rate"))


@section("SELECT n_nationkey, upper(replace(n_name, 'NATION_', 'PEÑALOLEN_')) AS raw, 'PENALOLEN_' || CAST(n_nationkey AS VARCHAR) AS id FROM nation")
def b17_slug(t: Tables) -> DataFrame:
    raw = F.upper(F.regexp_replace("n_name", "NATION_", "PEÑALOLEN_"))
    return t.nation.select("n_nationkey", raw.alias("raw"), cleaning.slug(F.concat(F.lit("Servicio "), F.lower(F.regexp_replace(raw, "LEN_", "lén -"))), "Servicio ").alias("id"))


MONTHLY = f"""{VISITS}, monthly AS (SELECT area, CAST(date_trunc('month', day) AS DATE) AS month, sum(CASE WHEN cause LIKE 'A%' THEN total ELSE 0 END) AS occupied, sum(total) AS available FROM visits GROUP BY ALL)"""


def monthly(t: Tables) -> DataFrame:
    """(area, month, occupied, available): bed days of an area and month; part of all quantities is occupied."""
    return visits(t).groupBy("area", F.trunc("day", "month").alias("month")).agg(F.sum(F.when(F.col("cause").startswith("A"), F.col("total")).otherwise(0)).alias("occupied"), F.sum("total").alias("available"))


@section(f"""WITH {MONTHLY} SELECT area, month, CAST(day(last_day(month)) AS INTEGER) AS days, occupied / day(last_day(month)) AS mean_occupied, (available - occupied) / day(last_day(month)) AS free, 100.0::DOUBLE * occupied / available AS index FROM monthly""")
def b18_identities(t: Tables) -> DataFrame:
    days = F.dayofmonth(F.last_day("month"))
    return monthly(t).select("area", "month", days.alias("days"), (F.col("occupied") / days).alias("mean_occupied"), ((F.col("available") - F.col("occupied")) / days).alias("free"), (100.0 * F.col("occupied") / F.col("available")).alias("index"))


@section("SELECT CAST(year(o_orderdate) AS INTEGER) AS year, CAST(dayofyear(make_date(year(o_orderdate), 12, 31)) AS INTEGER) AS days, count(*) / dayofyear(make_date(year(o_orderdate), 12, 31)) AS per_day FROM orders GROUP BY year(o_orderdate)")
def b19_year_length(t: Tables) -> DataFrame:
    by_year = t.orders.groupBy(F.year("o_orderdate").alias("year")).agg(F.count("*").alias("n"))
    days = calendar.year_days(F.col("year"))
    return by_year.select("year", days.alias("days"), (F.col("n") / days).alias("per_day"))


@section("SELECT o_custkey, count(*) FILTER (year(o_orderdate) = 2001) AS beds, 2001 AS year FROM orders GROUP BY 1")
def b20_newest_column(t: Tables) -> DataFrame:
    wide = t.orders.groupBy("o_custkey").agg(*(F.count_if(F.year("o_orderdate") == y).alias(f"beds_{y}" + "*" * (y == 2001)) for y in (1999, 2000, 2001)))
    name, year = cleaning.newest_column(wide.columns, "beds_")
    return wide.select("o_custkey", F.col(f"`{name}`").alias("beds"), F.lit(year).alias("year"))


_RECENT = f"""{PANEL}, x AS (SELECT series_id, avg(CASE WHEN t > m - 4 THEN y END) AS recent, CAST(min(CASE WHEN t BETWEEN m - 55 AND m - 4 THEN y END) AS DOUBLE) AS lower, CAST(max(CASE WHEN t BETWEEN m - 55 AND m - 4 THEN y END) AS DOUBLE) AS upper FROM panel, (SELECT max(t) AS m FROM panel) GROUP BY 1)"""


@section(f"WITH {_RECENT} SELECT series_id, recent < lower OR recent > upper AS outside FROM x")
def b21_outside_interval(t: Tables) -> DataFrame:
    p = panel(t)
    last = p.agg(F.max("t").alias("m"))
    of = p.crossJoin(F.broadcast(last)).groupBy("series_id").agg(F.avg(F.when(F.col("t") > F.col("m") - 4, F.col("y"))).alias("recent"), F.min(F.when(F.col("t").between(F.col("m") - 55, F.col("m") - 4), F.col("y"))).alias("lower"), F.max(F.when(F.col("t").between(F.col("m") - 55, F.col("m") - 4), F.col("y"))).alias("upper"))
    known = F.col("recent").isNotNull() & F.col("lower").isNotNull() & F.col("upper").isNotNull()
    return of.select("series_id", F.when(known, (F.col("recent") < F.col("lower")) | (F.col("recent") > F.col("upper"))).alias("outside"))


@section(f"WITH {PANEL} SELECT series_id, t, y > 2 * m AS implausible FROM (SELECT series_id, t, y, max(y) OVER (PARTITION BY series_id ORDER BY t ROWS BETWEEN 52 PRECEDING AND 1 PRECEDING) AS m FROM panel) WHERE m IS NOT NULL")
def b22_plausibility(t: Tables) -> DataFrame:
    most = F.max("y").over(W.partitionBy("series_id").orderBy("t").rowsBetween(-52, -1))
    return panel(t).withColumn("m", most).where("m is not null").select("series_id", "t", (F.col("y") > 2 * F.col("m")).alias("implausible"))


@section(f"SELECT o_orderkey, CAST(year(d) AS INTEGER) AS year, {sql_week('d')} AS week FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders)")
def f1_agency_week(t: Tables) -> DataFrame:
    return calendar.with_week(t.orders.withColumn("day", F.to_date("o_orderdate")), "day").select("o_orderkey", "year", "week")


@section(f"""SELECT year, week, min(day) AS first_day, max(day) AS last_day, count(*) AS days FROM (SELECT CAST(d AS DATE) AS day, CAST(year(d) AS INTEGER) AS year, {sql_week('CAST(d AS DATE)')} AS week
    FROM (SELECT unnest(generate_series(min(CAST(l_shipdate AS DATE)), max(CAST(l_shipdate AS DATE)), INTERVAL 1 DAY)) AS d FROM lineitem)) GROUP BY ALL""")
def f2_calendar(t: Tables) -> DataFrame:
    """The weeks between the first and the last day of the facts."""
    span = t.lineitem.agg(F.min(F.to_date("l_shipdate")).alias("a"), F.max(F.to_date("l_shipdate")).alias("b"))
    return calendar.weeks_of(span.select(F.explode(F.sequence("a", "b")).alias("day")))


_WEEKS = f"SELECT CAST(year(day) AS INTEGER) AS year, {sql_week('day')} AS week, count(DISTINCT day) AS days, max(day) AS last_day FROM visits GROUP BY ALL"


@section(f"WITH {VISITS}, w AS ({_WEEKS}) SELECT year, week, days, dayofweek(last_day) = 6 OR (month(last_day) = 12 AND day(last_day) = 31) AS closed, week <= 52 AND days < 7 AS truncated FROM w")
def f3_closed_weeks(t: Tables) -> DataFrame:
    w = calendar.with_week(visits(t), "day").groupBy("year", "week").agg(F.count_distinct("day").alias("days"), F.max("day").alias("last_day"))
    return w.select("year", "week", "days", calendar.closed(F.col("last_day")).alias("closed"), ((F.col("week") <= 52) & (F.col("days") < 7)).alias("truncated"))


@section(f"""WITH {PANEL}, m AS (SELECT series_id, max(t) AS t, max_by(year, t) AS year, max_by(week, t) AS week FROM panel GROUP BY 1)
    SELECT series_id, CAST(t + h AS INTEGER) AS t, CAST(year + (week - 1 + h) // 52 AS INTEGER) AS year, CAST((week - 1 + h) % 52 + 1 AS INTEGER) AS week, CAST(h AS INTEGER) AS horizon FROM m, generate_series(1, 60) g(h)""")
def f4_future_periods(t: Tables) -> DataFrame:
    from tallyfold.operators import panels

    return panels.future_rows(panel(t), 60).select("series_id", "t", "year", "week", "horizon")


_YEARS = "years AS (SELECT DISTINCT CAST(year(o_orderdate) + k * 7 AS INTEGER) AS year FROM orders, generate_series(0, 14) g(k))"


def _years(t: Tables) -> DataFrame:
    """Years of the orders and on, 105 at most."""
    return t.orders.select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(14)), lambda k: F.year("o_orderdate") + 7 * k)).alias("year")).distinct()


_EASTER = """e AS (SELECT year, make_date(CAST(((h + l - 7 * ((a + 11 * h + 22 * l) // 451) + 114) // 31 * 0 + year) AS BIGINT), CAST((h + l - 7 * ((a + 11 * h + 22 * l) // 451) + 114) // 31 AS BIGINT), CAST((h + l - 7 * ((a + 11 * h + 22 * l) // 451) + 114) % 31 + 1 AS BIGINT)) AS easter FROM (
    SELECT *, (32 + 2 * (b % 4) + 2 * (c // 4) - h - c % 4) % 7 AS l FROM (SELECT *, (19 * a + b - b // 4 - (b - (b + 8) // 25 + 1) // 3 + 15) % 30 AS h FROM (SELECT year, year % 19 AS a, year // 100 AS b, year % 100 AS c FROM years))))"""


@section(f"WITH {_YEARS}, {_EASTER} SELECT year, easter, CAST(make_date(year, 5, 1) + CAST((7 - dayofweek(make_date(year, 5, 1))) % 7 + 7 AS INTEGER) AS DATE) AS mothers_day FROM e")
def f5_easter(t: Tables) -> DataFrame:
    y = F.col("year")
    return _years(t).select("year", calendar.easter(y).alias("easter"), calendar.nth_weekday(y, 5, 1, 2).alias("mothers_day"))


_SUNDAY = "make_date(year, {0}, 1) + CAST((7 - dayofweek(make_date(year, {0}, 1))) % 7 + {1} AS INTEGER)"
HOLIDAYS = f"""{_YEARS}, {_EASTER}, holidays AS (SELECT year, 'new_year' AS event, make_date(year - 1, 12, 31) AS from_day, make_date(year, 1, 1) AS to_day FROM e
    UNION ALL SELECT year, 'christmas', make_date(year, 12, 24), make_date(year, 12, 25) FROM e UNION ALL SELECT year, 'all_saints', make_date(year, 10, 31), make_date(year, 11, 1) FROM e
    UNION ALL SELECT year, 'holy_week', easter - 2, easter FROM e UNION ALL SELECT year, 'national_days', make_date(year, 9, 18), make_date(year, 9, 19) FROM e
    UNION ALL SELECT year, 'mothers_day', {_SUNDAY.format(5, 7)}, {_SUNDAY.format(5, 7)} FROM e UNION ALL SELECT year, 'fathers_day', {_SUNDAY.format(6, 14)}, {_SUNDAY.format(6, 14)} FROM e)"""


@section(f"WITH {HOLIDAYS} SELECT * FROM holidays")
def f6_holidays(t: Tables) -> DataFrame:
    return calendar.holidays(_years(t))


def _season(month: int, year: str) -> str:
    """Local date by the same published terms."""
    at = f"({year} - 2000)"
    powers = " + ".join(f"{c}::DOUBLE * power({at} / 1000.0::DOUBLE, {k})" for k, c in enumerate(calendar.SEASON_MEANS[month]))
    ahead = " + ".join(f"{c}::DOUBLE * power({at} + 0.5::DOUBLE, {k})" for k, c in enumerate(calendar.CLOCK_AHEAD))
    terms = " + ".join(f"{a} * cos(radians({b}::DOUBLE + {c}::DOUBLE * u))" for a, b, c in calendar.SEASON_TERMS)
    instant = f"m + 0.00001::DOUBLE * ({terms}) / (1 + 0.0334::DOUBLE * cos(radians(35999.373::DOUBLE * u - 2.47::DOUBLE)) + 0.0007::DOUBLE * cos(2 * radians(35999.373::DOUBLE * u - 2.47::DOUBLE)))"
    return f"(SELECT CAST(timezone('America/Santiago', to_timestamp(floor(({instant} - 2440587.5::DOUBLE) * 86400 - ({ahead})))) AS DATE) FROM (SELECT m, (m - 2451545.0::DOUBLE) / 36525 AS u FROM (SELECT {powers} AS m)))"


@section(f"WITH {_YEARS}, s AS (SELECT year, {', '.join(f'{_season(m, y)} AS s{k}' for k, (m, y) in enumerate(((3, 'year'), (6, 'year'), (9, 'year'), (12, 'year'), (3, '(year + 1)'))))} FROM years) " + " UNION ALL ".join(f"SELECT year, '{n}' AS season, s{k} AS from_day, s{k + 1} - 1 AS to_day FROM s" for k, n in enumerate(("autumn", "winter", "spring", "summer"))))
def f7_seasons(t: Tables) -> DataFrame:
    return calendar.seasons(_years(t))


@section(f"WITH {PANEL} SELECT series_id, t, round(sin(2 * pi() * week / 52), 9) AS sin_1, round(cos(2 * pi() * week / 52), 9) AS cos_1, round(sin(4 * pi() * week / 52), 9) AS sin_2, round(cos(4 * pi() * week / 52), 9) AS cos_2 FROM panel")
def f8_fourier(t: Tables) -> DataFrame:
    return panel(t).select("series_id", "t", *(F.round(c, 9).alias(n) for n, c in calendar.fourier(F.col("week"), 2).items()))


@section("SELECT CAST(max(year(d)) FILTER (month(d) = 12 AND day(d) = 31) AS INTEGER) AS last_closed FROM (SELECT CAST(l_shipdate AS DATE) AS d FROM lineitem)")
def f9_last_closed_year(t: Tables) -> DataFrame:
    d = F.to_date("l_shipdate")
    return t.lineitem.agg(F.max(F.when((F.month(d) == 12) & (F.dayofmonth(d) == 31), F.year(d))).alias("last_closed"))


@section(f"WITH {VISITS}, {CALENDAR}, d AS (SELECT DISTINCT day, CAST(year(day) AS INTEGER) AS year, {sql_week('day')} AS week FROM visits) SELECT count(*) AS days, count(*) FILTER (day NOT BETWEEN first_day AND last_day) AS mismatches FROM d JOIN calendar USING (year, week)")
def f10_calendar_check(t: Tables) -> DataFrame:
    days = calendar.with_week(visits(t).select("day").distinct(), "day")
    return days.join(calendar_table(t), ["year", "week"]).agg(F.count("*").alias("days"), F.count_if(~F.col("day").between(F.col("first_day"), F.col("last_day"))).alias("mismatches"))


