"""2.9 marts and 2.10 capacity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.operators import capacity
from tallyfold.plans import marts
from tallyfold.plans.q_expressions import MONTHLY, STAYS, monthly
from tallyfold.plans.q_joins import PLACED, PLACES, REPORTS
from tallyfold.plans.testbed import VISITS, WEEKLY, Section, Tables, sql_week

section = Section()
PIVOT = ", ".join(f"sum(total) FILTER (cause = '{c}') AS n_{c}" for c in marts.CAUSES)
_PEOPLE = "people AS (SELECT c_nationkey AS area, count(*) AS people FROM customer GROUP BY 1)"


@section(f"WITH {WEEKLY}, {_PEOPLE}, m AS (SELECT area, year, week, {PIVOT}, count(DISTINCT facility) AS reporters FROM weekly GROUP BY ALL), s AS (SELECT area, year, week, CAST(sum(total) AS BIGINT) AS total FROM weekly GROUP BY ALL) SELECT m.*, total, n_AF / total AS \"share_AF\", total * 10000.0::DOUBLE / people AS rate FROM m JOIN s USING (area, year, week) JOIN people USING (area)")
def j1_area_weekly_mart(t: Tables) -> DataFrame:
    return marts.visit_mart(t, "week")


@section(f"WITH {VISITS}, {_PEOPLE}, v AS (SELECT *, CAST(date_trunc('month', day) AS DATE) AS month FROM visits), m AS (SELECT area, month, {PIVOT}, count(DISTINCT facility) AS reporters FROM v GROUP BY ALL), s AS (SELECT area, month, CAST(sum(total) AS BIGINT) AS total FROM v GROUP BY ALL) SELECT m.*, total, n_AF / total AS \"share_AF\", total * 10000.0::DOUBLE / people AS rate FROM m JOIN s USING (area, month) JOIN people USING (area)")
def j1_area_monthly_mart(t: Tables) -> DataFrame:
    return marts.visit_mart(t, "month")


@section(f"WITH {VISITS} SELECT facility, CAST(date_trunc('month', day) AS DATE) AS month, {PIVOT} FROM visits GROUP BY ALL")
def j2_facility_monthly_mart(t: Tables) -> DataFrame:
    return marts.facility_mart(t, "month")


@section(f"WITH {WEEKLY} SELECT facility, year, week, {PIVOT.replace('n_RO', 'n_extra')} FROM weekly GROUP BY ALL")
def j3_facility_weekly_mart(t: Tables) -> DataFrame:
    return marts.facility_mart(t, "week")


@section("WITH e AS (SELECT l_suppkey AS s_suppkey, bool_or(l_quantity > 49) AS r, CAST(max(year(l_shipdate)) FILTER (l_quantity > 49) AS INTEGER) AS last_year FROM lineitem GROUP BY 1) SELECT s_suppkey, s_acctbal > 2000 AS core, coalesce(r, false) AS ever_reported, last_year, s_acctbal > 2000 OR last_year >= 2001 AS included FROM supplier LEFT JOIN e USING (s_suppkey)")
def j4_supply_dimension(t: Tables) -> DataFrame:
    return marts.supply_dimension(t)


_BEDS = "beds AS (SELECT s_suppkey, beds, coalesce(declared, 0) AS declared FROM supplier LEFT JOIN (SELECT p_partkey % 120 AS s_suppkey, sum(CASE WHEN p_size > 40 THEN p_size END) AS beds, count(CASE WHEN p_size > 40 THEN 1 END) AS declared FROM part WHERE p_partkey % 120 % 4 <> 0 GROUP BY 1) USING (s_suppkey))"


@section(f"WITH {_BEDS} SELECT s_suppkey, CAST(beds AS BIGINT) AS beds, declared FROM beds")
def j5_bed_dimension(t: Tables) -> DataFrame:
    return marts.bed_dimension(t)


@section(f"WITH {MONTHLY} SELECT area, month, CAST(occupied AS BIGINT) AS occupied, CAST(available AS BIGINT) AS available, CAST(day(last_day(month)) AS INTEGER) AS days, occupied / day(last_day(month)) AS mean_occupied, (available - occupied) / day(last_day(month)) AS mean_free, CASE WHEN available > 0 THEN 100.0::DOUBLE * occupied / available END AS index FROM monthly")
def j6_occupancy_mart(t: Tables) -> DataFrame:
    return marts.occupancy_mart(t)


SPARSE = f"""cal AS (SELECT year, week, min(day) AS first_day, count(*) AS days FROM (SELECT CAST(d AS DATE) AS day, CAST(year(d) AS INTEGER) AS year, {sql_week('CAST(d AS DATE)')} AS week FROM (SELECT unnest(generate_series(min(CAST(o_orderdate AS DATE)), max(CAST(o_orderdate AS DATE)), INTERVAL 1 DAY)) AS d FROM orders)) GROUP BY ALL),
    cnt AS (SELECT o_orderpriority AS priority, CAST(year(day) AS INTEGER) AS year, {sql_week('day')} AS week, count(*) AS n FROM (SELECT *, CAST(o_orderdate AS DATE) AS day FROM orders WHERE o_totalprice > 300000) GROUP BY ALL),
    f AS (SELECT priority, c.year, c.week, first_day, days, coalesce(n, 0) AS n FROM (SELECT DISTINCT o_orderpriority AS priority FROM orders) CROSS JOIN cal c LEFT JOIN cnt USING (priority, year, week)),
    w AS (SELECT *, quantile_cont(n, 0.5) OVER w AS med, count(*) OVER w AS k FROM f WINDOW w AS (PARTITION BY priority ORDER BY first_day ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING)),
    sparse AS (SELECT priority, year, week, days, n, first_day, NOT bool_or(k < 8 OR n >= 0.75 * med) OVER (PARTITION BY priority ORDER BY first_day DESC ROWS UNBOUNDED PRECEDING) AS late FROM w)"""


@section(f"WITH {SPARSE} SELECT priority, year, week, days, n, late FROM sparse")
def j7_sparse_mart(t: Tables) -> DataFrame:
    return marts.sparse_mart(t)


DISCHARGES = f"{STAYS}, c(o_orderpriority, harmonised) AS (VALUES ('1-URGENT', 'high'), ('2-HIGH', 'high'), ('5-LOW', 'low')), discharges AS (SELECT o_orderkey, CAST(year(day) AS INTEGER) AS year, harmonised, least(days, 365) AS stay, days > 365 AS long_stay, c_nationkey AS area, CASE WHEN c_nationkey % 6 <> 0 THEN c_nationkey < 10 END AS resident FROM stays JOIN c USING (o_orderpriority) JOIN customer ON o_custkey = c_custkey)"


@section(f"WITH {DISCHARGES} SELECT * FROM discharges")
def j8_discharge_set(t: Tables) -> DataFrame:
    return marts.discharge_set(t)


@section(f"WITH {DISCHARGES}, {_PEOPLE}, y AS (SELECT DISTINCT CAST(year(o_orderdate) AS INTEGER) AS year FROM orders), b AS (SELECT area, year, count(*) AS n, quantile_cont(stay, 0.5) AS median, quantile_cont(stay, 0.9) AS p90, avg(CASE WHEN long_stay THEN 1.0::DOUBLE ELSE 0 END) AS share_long FROM discharges GROUP BY ALL) SELECT area, year, coalesce(n, 0) AS n, median, round(p90, 6) AS p90, share_long, coalesce(n, 0) * 10000.0::DOUBLE / people AS rate FROM people CROSS JOIN y LEFT JOIN b USING (area, year)")
def j9_resident_profile(t: Tables) -> DataFrame:
    return marts.resident_profile(t).withColumn("p90", F.round("p90", 6))


@section(f"WITH {DISCHARGES}, {MONTHLY}, s AS (SELECT year, sum(stay) AS d FROM discharges GROUP BY 1), m AS (SELECT CAST(year(month) AS INTEGER) AS year, sum(occupied) AS o FROM monthly GROUP BY 1 HAVING count(DISTINCT month) = 12) SELECT year, d / dayofyear(make_date(year, 12, 31)) AS from_stays, o / dayofyear(make_date(year, 12, 31)) AS from_months, (d / dayofyear(make_date(year, 12, 31))) / (o / dayofyear(make_date(year, 12, 31))) AS ratio FROM s JOIN m USING (year)")
def j10_bed_contrast(t: Tables) -> DataFrame:
    return marts.bed_contrast(t)


@section("""SELECT n_nationkey, n_name, r_name, coalesce(customers, 0) AS customers, coalesce(suppliers, 0) AS suppliers, orders, last_order, lines, last_ship, last_order AS as_of_orders, last_ship AS as_of_lines FROM nation JOIN region ON n_regionkey = r_regionkey
    LEFT JOIN (SELECT c_nationkey AS k, count(*) AS customers FROM customer GROUP BY 1) c ON c.k = n_nationkey LEFT JOIN (SELECT s_nationkey AS k, count(*) AS suppliers FROM supplier GROUP BY 1) s ON s.k = n_nationkey
    LEFT JOIN (SELECT c_nationkey AS k, count(*) AS orders, max(CAST(o_orderdate AS DATE)) AS last_order FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1) o ON o.k = n_nationkey
    LEFT JOIN (SELECT s_nationkey AS k, count(*) AS lines, max(CAST(l_shipdate AS DATE)) AS last_ship FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1) l ON l.k = n_nationkey""")
def j11_territorial_snapshot(t: Tables) -> DataFrame:
    return marts.territorial_snapshot(t).withColumns({"as_of_orders": F.col("last_order"), "as_of_lines": F.col("last_ship")})


@section("SELECT CAST(c_nationkey AS VARCHAR) AS unit, count(*)::DOUBLE AS value, 'customers' AS indicator, 'customer' AS source FROM customer GROUP BY c_nationkey UNION ALL SELECT CAST(s_nationkey AS VARCHAR), count(*), 'suppliers', 'supplier' FROM supplier GROUP BY s_nationkey UNION ALL SELECT o_orderstatus, count(*), 'orders', 'orders' FROM orders GROUP BY o_orderstatus UNION ALL SELECT p_brand, max(p_size), 'largest', 'part' FROM part GROUP BY p_brand")
def j12_context_mart(t: Tables) -> DataFrame:
    return marts.context_mart(t)


@section(f"""WITH {REPORTS}, i AS (SELECT *, row_number() OVER (PARTITION BY facility ORDER BY t) - row_number() OVER (PARTITION BY facility, reported ORDER BY t) AS island, min(t) FILTER (reported) OVER (PARTITION BY facility) AS f, max(t) FILTER (reported) OVER (PARTITION BY facility) AS l FROM reports), p AS (SELECT facility, reported, island, count(*) AS n, min(t) AS a, max(t) AS b, any_value(f) AS f, any_value(l) AS l FROM i GROUP BY ALL),
    r AS (SELECT facility, coalesce(max(n) FILTER (reported), 0) AS longest_on, coalesce(max(n) FILTER (NOT reported), 0) AS longest_off, count(*) FILTER (NOT reported AND a > f AND b < l) AS gaps FROM p GROUP BY 1), s AS (SELECT facility, count(*) AS expected, count(*) FILTER (reported) AS reported FROM reports GROUP BY 1),
    w AS (SELECT facility, year, week, sum(total) AS n FROM weekly WHERE cause = 'AF' AND week <= 52 GROUP BY ALL), x AS (SELECT facility, avg(n) AS mean, round(stddev_pop(n), 6) AS sd FROM w GROUP BY 1)
    SELECT facility, expected, reported, longest_on, longest_off, gaps, mean, sd FROM s JOIN r USING (facility) LEFT JOIN x USING (facility)""")
def j13_reporting_profile(t: Tables) -> DataFrame:
    return marts.reporting_profile(t)


@section(f"WITH {PLACED} SELECT status, count(*) AS n, count(area) AS placed FROM status GROUP BY 1")
def j14_supply_layer(t: Tables) -> DataFrame:
    from tallyfold.operators import joins
    from tallyfold.plans import q_joins

    p = q_joins.placed(t)
    status = joins.place_status(F.col("declared"), F.col("area"), F.col("n_inside"), F.col("n_border"), F.col("x"))
    return p.groupBy(status.alias("status")).agg(F.count("*").alias("n"), F.count("area").alias("placed"))


_REASONS = {"locate": "in the supply: to be located from a verifiable source before distances are measured", "leave_closed": "closed: not in the supply, neither located nor imputed", "leave_outside": "open but not in the supply: its coordinates are not used"}


@section(f"""WITH {PLACED}, r AS (SELECT vec_id, status AS problem, vec_id % 3 = 0 AS in_supply, vec_id % 5 <> 0 AS is_open, CASE WHEN vec_id % 3 = 0 THEN 'locate' WHEN vec_id % 5 = 0 THEN 'leave_closed' ELSE 'leave_outside' END AS resolution FROM status WHERE status <> 'match')
    SELECT *, CASE problem WHEN 'no_coordinates' THEN 'has no coordinates' WHEN 'outside' THEN 'lies in no area' WHEN 'ambiguous' THEN 'lies on a border' ELSE 'lies in another area than declared' END || '; ' || CASE resolution {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in _REASONS.items())} END AS reason FROM r""")
def j15_resolution_list(t: Tables) -> DataFrame:
    return marts.resolution_list(t)


@section(f"""WITH {PLACES}, r AS (SELECT vec_id % 7 AS area, round(km, 6) AS km, sum(people) AS w FROM near GROUP BY ALL), c AS (SELECT *, sum(w) OVER (PARTITION BY area ORDER BY km) AS cum, sum(w) OVER (PARTITION BY area) AS total FROM r)
    SELECT area, CAST(any_value(total) AS BIGINT) AS people, sum(w) FILTER (km <= 50) / any_value(total) AS within_50, min(km) FILTER (cum >= 0.5::DOUBLE * total) AS median_km, min(km) FILTER (cum >= 0.9::DOUBLE * total) AS p90_km FROM c GROUP BY 1""")
def j16_proximity(t: Tables) -> DataFrame:
    return marts.proximity(t)


@section("WITH f AS (SELECT o_custkey, min(year(o_orderdate)) AS since FROM orders GROUP BY 1), y AS (SELECT DISTINCT CAST(year(o_orderdate) AS INTEGER) AS year FROM orders) SELECT c_nationkey AS area, year, count(*) AS people FROM customer JOIN f ON o_custkey = c_custkey JOIN y ON since <= year GROUP BY ALL")
def j17_population_dimension(t: Tables) -> DataFrame:
    return marts.population_dimension(t)


@section("""WITH p AS (SELECT vec_id, CASE WHEN vec_id % 40 = 3 THEN NULL WHEN vec_id % 40 = 7 THEN 0 ELSE CAST(label + 1 AS BIGINT) END AS people FROM embeddings), b AS (SELECT *, 'urban' AS layer FROM p WHERE vec_id % 5 <> 0 UNION ALL SELECT *, 'rural' FROM p WHERE vec_id % 10 = 0 UNION ALL SELECT *, 'rural' FROM p WHERE vec_id = 1)
    SELECT vec_id, layer, people, CASE WHEN count(*) OVER (PARTITION BY vec_id) > 1 THEN 'shared id' WHEN people IS NULL THEN 'no weight' WHEN people <= 0 THEN 'weight not positive' END AS violation FROM b""")
def j19_population_points(t: Tables) -> DataFrame:
    return marts.population_points(t)


@section("""WITH r AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, CASE WHEN o_orderkey % 9 <> 0 AND o_orderkey % 130 <= 127 THEN o_orderkey % 130 END AS age, o_orderkey % 100 AS g FROM orders)
    SELECT o_orderkey, day, age, concat_ws(',', CASE WHEN age IS NULL THEN 'bad_age' END, CASE WHEN year(day) < 1996 THEN 'early' END) AS tags, count(*) OVER (PARTITION BY age, g) AS copies FROM r""")
def j18_death_register(t: Tables) -> DataFrame:
    return marts.death_register(t)


def tight(t: Tables) -> DataFrame:
    """Beds with a load near capacity: a third of the areas is over it in some months."""
    return monthly(t).withColumn("available", F.ceil(F.col("occupied") * 10 / 8) - (F.col("area") % 3) * F.lit(40))


TIGHT = f"{MONTHLY}, tight AS (SELECT area, month, occupied, CAST(ceil(occupied * 10 / 8) AS BIGINT) - (area % 3) * 40 AS available FROM monthly)"
_DAYS = "day(last_day(month))"


@section(f"WITH {TIGHT} SELECT area, count(*) AS months, count(*) FILTER ((available - occupied) / {_DAYS} < 1) AS short, count(*) FILTER (occupied > available) AS over, max(month) AS last_month, arg_max(occupied, month) AS last_occupied, arg_max(available, month) AS last_available, 100.0::DOUBLE * sum(occupied) / sum(available) AS index FROM tight WHERE available > 0 GROUP BY 1")
def k1_area_summary(t: Tables) -> DataFrame:
    return capacity.area_summary(tight(t), "area")


@section(f"WITH {TIGHT}, r AS (SELECT * FROM tight WHERE year(month) * 12 + month(month) > (SELECT max(year(month) * 12 + month(month)) - 12 FROM tight) AND available > 0), x AS (SELECT area, 100.0::DOUBLE * sum(occupied) / sum(available) AS index, count(*) FILTER (occupied > available) AS over FROM r GROUP BY 1) SELECT *, CASE WHEN over > 0 THEN 'over_capacity' WHEN index >= 90 THEN 'saturation' WHEN index >= 85 THEN 'pressure' ELSE 'slack' END AS stress FROM x")
def k2_stress_level(t: Tables) -> DataFrame:
    return capacity.stress_level(tight(t), "area")


def _scenario(rows: str, now: str) -> str:
    return f"""(SELECT area, CASE WHEN last >= now_ OR now_ - last > 12 THEN 'not closed or old' WHEN n <> 12 THEN 'missing months' WHEN bad > 0 THEN 'incomplete or closed' END AS reason, CASE WHEN n = 12 AND bad = 0 AND last < now_ AND now_ - last <= 12 THEN (peak * 100 + 755160 * 85 - 1) // (755160 * 85) END AS target, (peak * 100 + 755160 * 90 - 1) // (755160 * 90) AS target_tight_, beds FROM (
        SELECT area, count(*) AS n, max(k) AS last, CAST(max(occupied * (755160 // {_DAYS})) AS BIGINT) AS peak, count(*) FILTER (occupied < 0 OR available <= 0) AS bad, arg_max(available / {_DAYS}, month) AS beds, {now} AS now_
        FROM (SELECT *, year(month) * 12 + month(month) AS k, max(year(month) * 12 + month(month)) OVER (PARTITION BY area) AS m FROM {rows}) WHERE k > m - 12 GROUP BY 1))"""


@section(f"WITH {TIGHT}, s AS (SELECT * FROM {_scenario('tight', '2001 * 12 + 12')}) SELECT area, reason, CAST(target AS BIGINT) AS target, CASE WHEN reason IS NULL THEN CAST(target_tight_ AS BIGINT) END AS target_tight, CASE WHEN reason IS NULL THEN greatest(target - beds, 0) END AS gap, CASE WHEN reason IS NULL THEN CAST(greatest(ceil(target - coalesce(CASE WHEN area % 4 <> 0 THEN area + 5.0::DOUBLE END, beds)), 0) AS BIGINT) END AS increase FROM s")
def k3_bed_scenario(t: Tables) -> DataFrame:
    declared = t.nation.select(F.col("n_nationkey").alias("area"), F.when(F.col("n_nationkey") % 4 != 0, F.col("n_nationkey") + 5.0).alias("declared"))
    return capacity.bed_scenario(tight(t), "area", declared, "2001-12-15")


_THEN = "then_ AS (SELECT area * 10000 + y AS area, month, occupied, available FROM tight, (SELECT DISTINCT year(month) AS y FROM tight) WHERE month < make_date(y, 1, 1))"


@section(f"WITH {TIGHT}, {_THEN}, s AS (SELECT CAST(area // 10000 AS INTEGER) AS area, CAST(area % 10000 AS INTEGER) AS year, CAST(target AS BIGINT) AS target FROM {_scenario('then_', '(area % 10000) * 12 + 1')} WHERE reason IS NULL) SELECT s.area, s.year, target, count(*) AS months, count(*) FILTER (occupied / {_DAYS} <= target) AS kept FROM s JOIN tight ON tight.area = s.area AND year(month) = s.year GROUP BY ALL")
def k4_scenario_check(t: Tables) -> DataFrame:
    return capacity.scenario_check(tight(t), "area")


@section(f"WITH {TIGHT}, e AS (SELECT area, quantile_cont(available / {_DAYS}, 0.5) AS median, max(available / {_DAYS}) AS largest FROM tight WHERE available > 0 GROUP BY 1), l AS (SELECT area, 'median' AS estimate, median AS beds FROM e UNION ALL SELECT area, 'largest', largest FROM e), d AS (SELECT n_nationkey AS area, n_nationkey + 5 AS declared FROM nation WHERE n_nationkey % 4 <> 0) SELECT estimate, count(*) AS n, count(*) FILTER (abs(round_even(beds, 0) - declared) = 0) AS exact, count(*) FILTER (abs(round_even(beds, 0) - declared) <= 1) AS near, round(avg(abs(beds - declared)), 6) AS mae FROM l JOIN d USING (area) GROUP BY 1")
def k5_endowment_backtest(t: Tables) -> DataFrame:
    declared = t.nation.select(F.col("n_nationkey").alias("area"), F.when(F.col("n_nationkey") % 4 != 0, F.col("n_nationkey") + 5.0).alias("declared"))
    return capacity.endowment_backtest(tight(t), "area", declared).withColumn("mae", F.round("mae", 6))


@section(f"WITH {TIGHT} SELECT area, count(*) AS months, max(100.0::DOUBLE * occupied / available) AS most FROM tight WHERE occupied > available AND available > 0 GROUP BY 1")
def k6_over_occupied(t: Tables) -> DataFrame:
    return capacity.over_occupied(tight(t), "area")


@section(f"WITH {MONTHLY}, q AS (SELECT area, year(month) AS y, quarter(month) AS q, sum(available) AS s, sum(available) + CASE WHEN area % 5 = 0 THEN 10 ELSE 0 END AS total FROM monthly GROUP BY area, year(month), quarter(month)) SELECT area, count(*) AS n, round(quantile_cont(total / s, 0.5), 9) AS ratio FROM q GROUP BY 1")
def k7_quarter_tie(t: Tables) -> DataFrame:
    m = monthly(t)
    quarters = m.groupBy("area", F.year("month").alias("year"), F.quarter("month").alias("quarter")).agg(F.sum("available").alias("total")).withColumn("total", F.col("total") + F.when(F.col("area") % 5 == 0, 10).otherwise(0))
    return capacity.quarter_tie(quarters, m, "area").withColumn("ratio", F.round("ratio", 9))


@section(f"WITH {TIGHT} SELECT area, min(month) AS first_month, max(month) AS last_month, count(DISTINCT month) AS published, CAST(max(year(month) * 12 + month(month)) - min(year(month) * 12 + month(month)) + 1 - count(DISTINCT month) AS BIGINT) AS missing, count(*) FILTER (occupied > available) AS over, CASE WHEN sum(available) > 0 THEN 100.0::DOUBLE * sum(occupied) / sum(available) END AS index FROM tight GROUP BY 1")
def k8_occupancy_report(t: Tables) -> DataFrame:
    return capacity.occupancy_report(tight(t), "area")
