"""2.13: the questions that a service would ask, as queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.functions import calendar
from tallyfold.operators import models, serve
from tallyfold.plans import marts
from tallyfold.plans.q_expressions import HOLIDAYS, _years
from tallyfold.plans.q_forecast import BACK, HORIZONS, PRINT
from tallyfold.plans.q_marts import _BEDS, DISCHARGES, SPARSE
from tallyfold.plans.testbed import PANEL, VISITS, WEEKLY, Section, Tables, panel, visits, weekly_visits
from tallyfold.sources import readers

section = Section()

FORECAST = f"""{PANEL}, m AS (SELECT max(t) AS m FROM panel), res AS (SELECT a.series_id, a.t, a.y - b.y AS r FROM panel a JOIN panel b ON b.series_id = a.series_id AND b.t = a.t - 52), q AS (SELECT series_id, quantile_cont(r, 0.1) AS low, quantile_cont(r, 0.9) AS high FROM res GROUP BY 1),
    forecast AS (SELECT series_id, level, CAST(t + 52 AS INTEGER) AS t, CAST(t + 52 - m AS INTEGER) AS horizon, y::DOUBLE AS y_pred, greatest(y + low, 0) AS lo, greatest(y + high, greatest(y + low, 0)) AS hi FROM panel JOIN q USING (series_id), m WHERE t + 52 > m AND t + 52 <= m + 8)"""


def forecast(t: Tables) -> DataFrame:
    return models.forecast(panel(t), "naive", 8)


@section(f"""WITH {FORECAST}, r AS (SELECT series_id, avg(y) AS recent FROM panel, m WHERE t > m - 4 AND level = 'leaf' GROUP BY 1), f AS (SELECT series_id, avg(y_pred) AS ahead, avg(lo) AS lo, avg(hi) AS hi FROM forecast WHERE horizon <= 4 AND level = 'leaf' GROUP BY 1)
    SELECT 'A' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS series_id, n_name, recent, ahead, round(100.0::DOUBLE * (ahead / recent - 1), 6) AS change, CASE WHEN ahead IS NULL THEN 'no forecast' WHEN 100.0::DOUBLE * (ahead / recent - 1) > 10 THEN 'rise' WHEN 100.0::DOUBLE * (ahead / recent - 1) < -10 THEN 'fall' ELSE 'stable' END AS label, recent < lo OR recent > hi AS outside
    FROM nation LEFT JOIN r ON r.series_id = 'A' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') LEFT JOIN f ON f.series_id = r.series_id""")
def q1_area_summary(t: Tables) -> DataFrame:
    names = t.nation.select(F.concat(F.lit("A"), F.lpad(F.col("n_nationkey").cast("string"), 2, "0")).alias("series_id"), "n_name")
    p, f = panel(t).where("level = 'leaf'"), forecast(t).where("level = 'leaf'")
    return serve.summary(p, f, names, window=4).withColumn("change", F.round("change", 6))


@section(f"WITH {FORECAST} SELECT series_id, t, 'history' AS kind, y::DOUBLE AS value, NULL AS lo, NULL AS hi FROM panel, m WHERE level = 'service' AND t > m - 26 UNION ALL SELECT series_id, t, 'forecast', y_pred, round(lo, 6), round(hi, 6) FROM forecast WHERE level = 'service'")
def q2_series(t: Tables) -> DataFrame:
    out = serve.series(panel(t).where("level = 'service'"), forecast(t).where("level = 'service'"), 26)
    return out.withColumns({"lo": F.round("lo", 6), "hi": F.round("hi", 6)})


@section(f"WITH {FORECAST} SELECT n_nationkey, coalesce(f.k IS NOT NULL, false) AS has_forecast, CASE WHEN f.k IS NULL THEN CASE WHEN n_nationkey % 10 = 3 THEN 'excluded: few reports' ELSE 'not in the panel' END END AS reason FROM nation LEFT JOIN (SELECT DISTINCT series_id AS k FROM forecast WHERE level = 'leaf' AND right(series_id, 1) <> '3') f ON f.k = 'A' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0')")
def q3_territories(t: Tables) -> DataFrame:
    key = F.concat(F.lit("A"), F.lpad(F.col("n_nationkey").cast("string"), 2, "0"))
    reasons = t.nation.where("n_nationkey % 10 = 3").select(key.alias("series_id"), F.lit("excluded: few reports").alias("reason"))
    areas = t.nation.select("n_nationkey", key.alias("series_id"))
    made = forecast(t).where("level = 'leaf' and right(series_id, 1) <> '3'")
    return serve.with_reasons(areas, made, reasons, "not in the panel").select("n_nationkey", "has_forecast", "reason")


@section(f"WITH {FORECAST} SELECT series_id, t, horizon, y_pred FROM forecast WHERE level = 'service' AND horizon = 2")
def q4_forecast_list(t: Tables) -> DataFrame:
    return serve.forecasts(forecast(t), level="service", horizon=2).select("series_id", "t", "horizon", "y_pred")


@section(f"WITH {WEEKLY}, w AS (SELECT year, week, count(DISTINCT day) AS days, sum(total) AS total FROM weekly WHERE week <= 52 GROUP BY ALL HAVING count(DISTINCT day) < 7) SELECT year, week, days, CAST(total AS BIGINT) AS total FROM w ORDER BY year DESC, week DESC LIMIT 1")
def q5_current_period(t: Tables) -> DataFrame:
    return serve.current_period(weekly_visits(t), "total")


@section(f"WITH {_BEDS} SELECT s_nationkey AS area, CAST(sum(beds) AS BIGINT) AS beds, count(*) AS hospitals, count(beds) AS declaring, string_agg(CASE WHEN beds IS NOT NULL THEN CAST(s_suppkey AS VARCHAR) || ':' || CAST(beds AS VARCHAR) END, ',' ORDER BY beds DESC, s_suppkey) AS ranked FROM supplier JOIN beds USING (s_suppkey) GROUP BY 1")
def q6_beds_of_territory(t: Tables) -> DataFrame:
    out = serve.beds(marts.bed_dimension(t).join(t.supplier, "s_suppkey").select(F.col("s_nationkey").alias("area"), "s_suppkey", "beds"), "area", "s_suppkey")
    listed = F.array_join(F.transform("ranked", lambda x: F.concat_ws(":", x["s_suppkey"], x["beds"])), ",")
    return out.withColumn("ranked", F.when(F.size("ranked") > 0, listed))


@section(f"WITH {VISITS}, x AS (SELECT facility, CAST(date_trunc('month', day) AS DATE) AS month, sum(total) AS n FROM visits GROUP BY ALL), m AS (SELECT max(month) AS m FROM x), r AS (SELECT facility, avg(n) FILTER (month > m - INTERVAL 3 MONTH) AS recent, avg(n) FILTER (month <= m - INTERVAL 12 MONTH AND month > m - INTERVAL 15 MONTH) AS before FROM x, m GROUP BY 1) SELECT s_suppkey AS facility, recent, before, round(100.0::DOUBLE * (recent / before - 1), 6) AS change, CASE WHEN recent IS NULL THEN 'no recent reports' WHEN before IS NULL THEN 'no base' END AS reason FROM supplier LEFT JOIN r ON facility = s_suppkey")
def q7_facility_summary(t: Tables) -> DataFrame:
    by_month = visits(t).groupBy("facility", F.trunc("day", "month").alias("month")).agg(F.sum("total").alias("n"))
    out = serve.facility_summary(by_month, t.supplier.select(F.col("s_suppkey").alias("facility")))
    return out.withColumn("change", F.round("change", 6))


@section(f"WITH {VISITS}, x AS (SELECT facility, CAST(date_trunc('month', day) AS DATE) AS month, sum(total) AS n FROM visits GROUP BY ALL) SELECT facility, string_agg(strftime(month, '%Y-%m') || '=' || CAST(n AS VARCHAR), ',' ORDER BY month) AS months FROM x GROUP BY 1")
def q7_facility_detail(t: Tables) -> DataFrame:
    by_month = visits(t).groupBy("facility", F.trunc("day", "month").alias("month")).agg(F.sum("total").alias("n"))
    out = serve.detail(by_month, "facility", "month", "n")
    return out.select("facility", F.array_join(F.transform("rows", lambda x: F.concat_ws("=", F.date_format(x["month"], "yyyy-MM"), x["n"])), ",").alias("months"))


@section("WITH m AS (SELECT max(CAST(o_orderdate AS DATE)) AS m FROM orders), p AS (SELECT c_nationkey AS area, count(*) AS people FROM customer GROUP BY 1) SELECT c_nationkey AS area, count(*) AS n, count(*) * 100000.0::DOUBLE / any_value(people) * 365.25::DOUBLE / 364 AS rate FROM orders JOIN customer ON o_custkey = c_custkey JOIN p ON area = c_nationkey, m WHERE CAST(o_orderdate AS DATE) > m - 364 GROUP BY 1".replace("* 365.25::DOUBLE / 364 AS rate", "* (365.25::DOUBLE / 364) AS rate"))
def q8_trailing_rate(t: Tables) -> DataFrame:
    events = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_nationkey").alias("area"), F.to_date("o_orderdate").alias("day"))
    people = t.customer.groupBy(F.col("c_nationkey").alias("area")).agg(F.count("*").alias("people"))
    return serve.trailing_rate(events, people, "area", "day", 364)


@section(f"WITH {DISCHARGES}, n AS (SELECT harmonised, year, count(*) AS n FROM discharges GROUP BY harmonised, year) SELECT harmonised, year, n, n / sum(n) OVER (PARTITION BY year) AS share FROM n")
def q9_resident_profile(t: Tables) -> DataFrame:
    return serve.shares(marts.discharge_set(t), ["year"], "harmonised")


@section(f"WITH {WEEKLY}, n AS (SELECT area, cause, CAST(sum(total) AS BIGINT) AS total FROM weekly WHERE (year, week) IN ((2000, 10), (2000, 20), (1999, 52)) GROUP BY area, cause) SELECT *, CAST(sum(total) OVER (PARTITION BY area) AS BIGINT) AS whole FROM n")
def q10_characterisation(t: Tables) -> DataFrame:
    chosen = t.spark.createDataFrame([(2000, 10), (2000, 20), (1999, 52)], "year int, week int")
    return serve.characterise(weekly_visits(t), chosen, ["year", "week"], "area", "cause", "total")


@section("""WITH n AS (SELECT c_mktsegment AS seg, o_orderstatus AS st, count(*) AS w FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL), x AS (SELECT *, sum(w) OVER (PARTITION BY seg) AS total, 1000 AS amount FROM n), y AS (SELECT *, amount * w // total AS base, amount * w % total AS rest FROM x), z AS (SELECT *, amount - sum(base) OVER (PARTITION BY seg) AS open_, row_number() OVER (PARTITION BY seg ORDER BY rest DESC, st) AS k FROM y)
    SELECT seg, st, CAST(base + CASE WHEN k <= open_ THEN 1 ELSE 0 END AS BIGINT) AS allocated FROM z""")
def q11_largest_remainder(t: Tables) -> DataFrame:
    w = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_mktsegment").alias("seg"), F.col("o_orderstatus").alias("st")).agg(F.count("*").alias("w"))
    return serve.largest_remainder(w, "seg", "st", "w", 1000)


@section(f"WITH {HOLIDAYS} SELECT event, from_day, to_day FROM holidays WHERE from_day <= DATE '1999-12-31' AND to_day >= DATE '1999-04-01'")
def q12_calendar_events(t: Tables) -> DataFrame:
    from tallyfold.operators import joins

    events = calendar.holidays(_years(t))
    return joins.overlapping(events, F.lit("1999-04-01").cast("date"), F.lit("1999-12-31").cast("date")).select("event", "from_day", "to_day")


@section(f"""WITH {BACK}, h AS (SELECT {PRINT} AS h FROM lineitem), w AS (SELECT year, week FROM weekly WHERE week <= 52 GROUP BY ALL HAVING count(DISTINCT day) < 7 ORDER BY year DESC, week DESC LIMIT 1)
    SELECT 'naive' AS model, 8 AS longest_horizon, count(*) AS evaluations, round(avg(CASE WHEN y_real BETWEEN lo AND hi THEN 1.0::DOUBLE ELSE 0 END), 6) AS coverage, any_value(w.year) AS partial_year, any_value(w.week) AS partial_week, (SELECT bit_xor(h) FROM h) AS input_fingerprint FROM back, w WHERE model = 'naive'""")
def q13_model_card(t: Tables) -> DataFrame:
    """One row: model, horizons, coverage, the newest partial week and the inputs' fingerprint."""
    from tallyfold.operators import evaluate

    back = models.backtest(panel(t), ["naive"], HORIZONS)
    covered = back.agg(*evaluate.coverage_and_width(0.8)).select(F.col("n").alias("evaluations"), F.round("coverage", 6).alias("coverage"))
    now = serve.current_period(weekly_visits(t), "total").select(F.col("year").alias("partial_year"), F.col("week").alias("partial_week"))
    prints = readers.fingerprint(t.lineitem).select(F.col("xor_hash").alias("input_fingerprint"))
    # one row each
    return covered.crossJoin(F.broadcast(now)).crossJoin(F.broadcast(prints)).withColumns({"model": F.lit("naive"), "longest_horizon": F.lit(8)})


@section(f"WITH {SPARSE}, m AS (SELECT max(first_day) AS m FROM sparse) SELECT priority, CAST(sum(n) FILTER (first_day > m - 364) AS BIGINT) AS last_year, max(first_day) FILTER (NOT late) AS cutoff, count(*) FILTER (late) AS late_weeks, avg(n) AS mean FROM sparse, m GROUP BY 1")
def q14_sparse_card(t: Tables) -> DataFrame:
    daily = t.orders.agg(F.min(F.to_date("o_orderdate")).alias("a"), F.max(F.to_date("o_orderdate")).alias("b"))
    weeks = calendar.weeks_of(daily.select(F.explode(F.sequence("a", "b")).alias("day"))).select("year", "week", "first_day")
    return serve.sparse_card(marts.sparse_mart(t).join(weeks.hint("merge"), ["year", "week"]), "priority", "first_day")


