"""2.3 joins, 2.5 windows and 2.7 sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.functions import calendar
from tallyfold.operators import joins, panels, quadtree, sets, windows
from tallyfold.plans.q_expressions import HOLIDAYS, _years
from tallyfold.plans.testbed import CALENDAR, PANEL, VISITS, WEEKLY, Section, Tables, calendar_table, panel, visits, weekly_visits

section = Section()


@section("SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, s_name, s_nationkey FROM lineitem JOIN supplier ON l_suppkey = s_suppkey")
def c1_lookup(t: Tables) -> DataFrame:
    suppliers = t.supplier.select(F.col("s_suppkey").alias("l_suppkey"), "s_name", "s_nationkey")
    return joins.lookup(t.lineitem, suppliers, ["l_suppkey"]).select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "s_name", "s_nationkey")


@section("""SELECT o_orderkey, coalesce(a.c_nationkey, b.n_nationkey) AS area, CASE WHEN coalesce(a.c_nationkey, b.n_nationkey) IS NULL THEN 'unknown' WHEN coalesce(a.c_nationkey, b.n_nationkey) < 5 THEN 'inside' ELSE 'outside' END AS place
    FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 3 = 0) a ON o_custkey = a.c_custkey LEFT JOIN nation b ON o_orderkey % 40 = b.n_nationkey""")
def c2_priority_lookup(t: Tables) -> DataFrame:
    first = t.customer.where("c_custkey % 3 = 0")
    rows = t.orders.withColumn("old_code", F.col("o_orderkey") % 40)
    found = joins.priority_lookup(rows, [("o_custkey", first, "c_custkey", "c_nationkey"), ("old_code", t.nation, "n_nationkey", "n_nationkey")], "area")
    return found.select("o_orderkey", "area", F.when(F.col("area").isNull(), "unknown").when(F.col("area") < 5, "inside").otherwise("outside").alias("place"))


@section("SELECT c_custkey, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') THEN 'member' ELSE 'other' END AS kind FROM customer")
def c3_membership(t: Tables) -> DataFrame:
    keys = t.orders.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    inside = t.customer.join(keys, "c_custkey", "left_semi").select("c_custkey", F.lit("member").alias("kind"))
    return inside.union(t.customer.join(keys, "c_custkey", "left_anti").select("c_custkey", F.lit("other").alias("kind")))


@section(f"""WITH {WEEKLY}, {CALENDAR} SELECT n_nationkey AS area, c.year, c.week, CAST(coalesce(sum(total), 0) AS BIGINT) AS total, count(DISTINCT facility) = 0 AS silent FROM nation CROSS JOIN calendar c LEFT JOIN weekly w ON w.area = n_nationkey AND w.year = c.year AND w.week = c.week GROUP BY ALL""")
def c4_grid(t: Tables) -> DataFrame:
    facts = weekly_visits(t).groupBy("area", "year", "week").agg(F.sum("total").alias("total"))
    units = t.nation.select(F.col("n_nationkey").alias("area"))
    full = joins.grid(units, calendar_table(t).select("year", "week"), facts.withColumn("seen", F.lit(True)), ["area", "year", "week"], zero=["total"])
    return full.select("area", "year", "week", "total", F.col("seen").isNull().alias("silent"))


@section("""SELECT a.year, orders, lines, lines / orders AS lines_per_order FROM (SELECT CAST(year(o_orderdate) AS INTEGER) AS year, count(*) AS orders FROM orders GROUP BY 1) a JOIN (SELECT CAST(year(l_shipdate) AS INTEGER) AS year, count(*) AS lines FROM lineitem GROUP BY 1) b USING (year)""")
def c5_contrast(t: Tables) -> DataFrame:
    a = t.orders.groupBy(F.year("o_orderdate").alias("year")).agg(F.count("*").alias("orders"))
    b = t.lineitem.groupBy(F.year("l_shipdate").alias("year")).agg(F.count("*").alias("lines"))
    return a.join(b, "year").select("year", "orders", "lines", (F.col("lines") / F.col("orders")).alias("lines_per_order"))


@section("""WITH a AS (SELECT DISTINCT l_suppkey AS k FROM lineitem WHERE l_quantity > 49 AND l_discount > 0.095), b AS (SELECT DISTINCT l_suppkey AS k FROM lineitem WHERE l_quantity < 2 AND l_discount < 0.005)
    SELECT coalesce(a.k, b.k) AS l_suppkey, CASE WHEN a.k IS NULL THEN 'right_only' WHEN b.k IS NULL THEN 'left_only' ELSE 'both' END AS origin FROM a FULL JOIN b ON a.k = b.k""")
def c6_full_outer(t: Tables) -> DataFrame:
    return joins.with_origin(t.lineitem.where("l_quantity > 49 and l_discount > 0.095"), t.lineitem.where("l_quantity < 2 and l_discount < 0.005"), ["l_suppkey"])


@section("""SELECT n_nationkey, n_name, r_name, coalesce(customers, 0) AS customers, coalesce(suppliers, 0) AS suppliers, orders, last_order, lines, last_ship FROM nation JOIN region ON n_regionkey = r_regionkey
    LEFT JOIN (SELECT c_nationkey AS k, count(*) AS customers FROM customer GROUP BY 1) c ON c.k = n_nationkey LEFT JOIN (SELECT s_nationkey AS k, count(*) AS suppliers FROM supplier GROUP BY 1) s ON s.k = n_nationkey
    LEFT JOIN (SELECT c_nationkey AS k, count(*) AS orders, max(CAST(o_orderdate AS DATE)) AS last_order FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1) o ON o.k = n_nationkey
    LEFT JOIN (SELECT s_nationkey AS k, count(*) AS lines, max(CAST(l_shipdate AS DATE)) AS last_ship FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1) l ON l.k = n_nationkey""")
def c7_star(t: Tables) -> DataFrame:
    from tallyfold.plans import marts

    return marts.territorial_snapshot(t)


@section("SELECT n_nationkey, n_name, n_regionkey, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def c8_guarded_attributes(t: Tables) -> DataFrame:
    return joins.attach(t.nation, t.region.withColumnRenamed("r_regionkey", "n_regionkey"), "n_regionkey").select("n_nationkey", "n_name", "n_regionkey", "r_name")


def points(t: Tables) -> DataFrame:
    """(vec_id, x, y, declared): the first two components as a place on a board of 10 by 10."""
    at = lambda k: F.round(F.col("embedding")[k].cast("double") * 40, 1) / 4 + 5
    keep = lambda c: F.when(F.col("vec_id") % 17 != 0, c)
    return t.embeddings.select("vec_id", keep(at(0)).alias("x"), keep(at(1)).alias("y"), F.pmod("label", F.lit(16)).cast("int").alias("declared"))


POINTS = "points AS (SELECT vec_id, CASE WHEN vec_id % 17 <> 0 THEN round(CAST(embedding[1] AS DOUBLE) * 40, 1) / 4 + 5 END AS x, CASE WHEN vec_id % 17 <> 0 THEN round(CAST(embedding[2] AS DOUBLE) * 40, 1) / 4 + 5 END AS y, CAST(label % 16 AS INTEGER) AS declared FROM embeddings)"


def squares(t: Tables) -> DataFrame:
    """(area, ring): 16 squares of side 2 that cover 8 by 8 of the board."""
    cells = t.spark.range(16).select(F.col("id").cast("int").alias("area"), (F.col("id") % 4 * 2 + 1).cast("double").alias("a"), (F.floor(F.col("id") / 4) * 2 + 1).cast("double").alias("b"))
    corner = lambda i, j: F.struct((F.col("a") + i).alias("x"), (F.col("b") + j).alias("y"))
    return cells.select("area", F.array(corner(0.0, 0.0), corner(2.0, 0.0), corner(2.0, 2.0), corner(0.0, 2.0), corner(0.0, 0.0)).alias("ring"))


def placed(t: Tables) -> DataFrame:
    found = joins.points_in_areas(points(t), joins.edges(squares(t), "ring", "area"), "vec_id", "area", cell=2.0)
    return found.join(points(t).select("vec_id", "declared"), "vec_id")


PLACED = f"""{POINTS}, sq AS (SELECT CAST(i AS INTEGER) AS area, CAST(i % 4 * 2 + 1 AS DOUBLE) AS a, CAST(i // 4 * 2 + 1 AS DOUBLE) AS b FROM generate_series(0, 15) g(i)),
    placed AS (SELECT vec_id, x, y, declared, CAST(count(*) FILTER (x > a AND x < a + 2 AND y > b AND y < b + 2) AS BIGINT) AS n_inside, CAST(count(*) FILTER (x BETWEEN a AND a + 2 AND y BETWEEN b AND b + 2 AND NOT (x > a AND x < a + 2 AND y > b AND y < b + 2)) AS BIGINT) AS n_border,
    min(area) FILTER (x > a AND x < a + 2 AND y > b AND y < b + 2) AS area FROM points LEFT JOIN sq ON true GROUP BY ALL),
    status AS (SELECT *, CASE WHEN x IS NULL THEN 'no_coordinates' WHEN n_border > 0 OR n_inside > 1 THEN 'ambiguous' WHEN n_inside = 0 THEN 'outside' WHEN area = declared THEN 'match' ELSE 'differs' END AS status FROM placed)"""


@section(f"WITH {PLACED} SELECT vec_id, area, status FROM status")
def c9_point_in_polygon(t: Tables) -> DataFrame:
    status = joins.place_status(F.col("declared"), F.col("area"), F.col("n_inside"), F.col("n_border"), F.col("x"))
    return placed(t).select("vec_id", "area", status.alias("status"))


def facilities(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Population points and facilities, from components scaled to degrees."""
    deg = lambda k, to: F.round(F.col("embedding")[k].cast("double") * 10, 3) + to
    rows = t.embeddings.select("vec_id", deg(0, -70.0).alias("lon"), deg(1, -33.0).alias("lat"), (F.col("label") + 1).cast("long").alias("people"))
    return rows.where("vec_id % 5 <> 0"), rows.where("vec_id % 5 = 0")


PLACES = """places AS (SELECT vec_id, round(CAST(embedding[1] AS DOUBLE) * 10, 3) - 70.0::DOUBLE AS lon, round(CAST(embedding[2] AS DOUBLE) * 10, 3) - 33.0::DOUBLE AS lat, CAST(label + 1 AS BIGINT) AS people FROM embeddings),
    pairs AS (SELECT p.vec_id, p.people, f.vec_id AS facility, 2 * 6371.0088::DOUBLE * asin(sqrt(least(1.0::DOUBLE, pow(sin(radians(f.lat - p.lat) / 2), 2) + cos(radians(p.lat)) * cos(radians(f.lat)) * pow(sin(radians(f.lon - p.lon) / 2), 2)))) AS km FROM places p, places f WHERE p.vec_id % 5 <> 0 AND f.vec_id % 5 = 0),
    near AS (SELECT vec_id, any_value(people) AS people, min(km) AS km, arg_min(facility, (km, facility)) AS facility, min(km) FILTER (facility % 10 = 0) AS km_subset FROM pairs GROUP BY vec_id)"""


@section(f"WITH {PLACES} SELECT vec_id, facility, round(km, 6) AS km, round(km_subset, 6) AS km_subset FROM near")
def c10_nearest(t: Tables) -> DataFrame:
    people, all_of = facilities(t)
    named = all_of.withColumnRenamed("vec_id", "facility")
    full = quadtree.nearest(people, named, "vec_id", "facility")
    subset = quadtree.nearest(people, named.where("facility % 10 = 0"), "vec_id", "facility").select("vec_id", F.col("km").alias("km_subset"))
    return full.join(subset, "vec_id").select("vec_id", "facility", F.round("km", 6).alias("km"), F.round("km_subset", 6).alias("km_subset"))


@section(f"WITH {HOLIDAYS} SELECT event, from_day, count(o_orderkey) AS orders FROM holidays LEFT JOIN orders ON CAST(o_orderdate AS DATE) BETWEEN from_day AND to_day WHERE from_day <= DATE '2000-12-31' AND to_day >= DATE '1997-01-01' GROUP BY ALL")
def c11_interval_overlap(t: Tables) -> DataFrame:
    events = joins.overlapping(calendar.holidays(_years(t)), F.lit("1997-01-01").cast("date"), F.lit("2000-12-31").cast("date"))
    days = events.select("event", "from_day", F.explode(F.sequence("from_day", "to_day")).alias("day"))
    by_day = t.orders.groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count("*").alias("n"))
    return days.join(by_day.hint("merge"), "day", "left").groupBy("event", "from_day").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("orders"))


@section("SELECT l_suppkey, l_orderkey, l_partkey, CAST(l_shipdate AS DATE) AS day FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate DESC, l_orderkey DESC, l_partkey DESC) AS r FROM lineitem) WHERE r = 1")
def c12_latest_attribute(t: Tables) -> DataFrame:
    return joins.latest(t.lineitem, ["l_suppkey"], [F.desc("l_shipdate"), F.desc("l_orderkey"), F.desc("l_partkey")]).select("l_suppkey", "l_orderkey", "l_partkey", F.to_date("l_shipdate").alias("day"))


@section("""WITH names AS (SELECT 'N' || CAST(n_nationkey % 20 AS VARCHAR) AS name, n_nationkey AS code FROM nation), g AS (SELECT name, min(code) AS code, count(DISTINCT code) AS codes FROM names GROUP BY 1)
    SELECT c_mktsegment, count(*) AS n, count(*) FILTER (code IS NULL) AS unmatched, count(*) FILTER (codes > 1) AS ambiguous FROM customer LEFT JOIN g ON name = 'N' || CAST(c_nationkey + 2 AS VARCHAR) GROUP BY 1""")
def c13_name_join(t: Tables) -> DataFrame:
    names = t.nation.select(F.concat(F.lit("N"), (F.col("n_nationkey") % 20).cast("string")).alias("name"), F.col("n_nationkey").alias("code"))
    one = names.groupBy("name").agg(F.min("code").alias("code"), F.count_distinct("code").alias("codes"))
    rows = t.customer.withColumn("name", F.concat(F.lit("N"), (F.col("c_nationkey") + 2).cast("string"))).join(one, "name", "left")
    return rows.groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.count_if(F.col("code").isNull()).alias("unmatched"), F.count_if(F.col("codes") > 1).alias("ambiguous"))


@section(f"""WITH {PANEL}, m AS (SELECT max(t) AS last FROM panel) SELECT series_id, CAST(t + 52 AS INTEGER) AS t, y AS y_pred FROM panel, m WHERE t + 52 BETWEEN last - 3 AND last + 8 AND t + 52 > last""")
def c15_future_only(t: Tables) -> DataFrame:
    from tallyfold.operators import models

    p = panel(t)
    ahead = p.select("series_id", (F.col("t") + 52).alias("t"), F.col("y").alias("y_pred"))
    last = p.agg(F.max("t").alias("last"))
    near = ahead.crossJoin(F.broadcast(last)).where("t between last - 3 and last + 8").drop("last")
    return models.future_only(near, p)


@section("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 100 <> 0)")
def c16_orphans(t: Tables) -> DataFrame:
    parents = t.orders.where("o_orderkey % 100 <> 0")
    return joins.orphans(t.lineitem, parents, "l_orderkey", "o_orderkey").select("l_orderkey", "l_linenumber", "l_partkey")


@section(f"WITH {PANEL} SELECT series_id, year, week, t FROM panel")
def e1_time_index(t: Tables) -> DataFrame:
    return panel(t).select("series_id", "year", "week", "t")


@section(f"""WITH {PANEL}, x AS (SELECT series_id, t, lag(y, 4) OVER w AS lag_0, lag(y, 5) OVER w AS lag_1, lag(y, 6) OVER w AS lag_2, lag(y, 7) OVER w AS lag_3, lag(y, 52) OVER w AS season, lag(y, 4) OVER w - lag(y, 56) OVER w AS year_change FROM panel WINDOW w AS (PARTITION BY series_id ORDER BY t)) SELECT * FROM x WHERE year_change IS NOT NULL""")
def e2_lags(t: Tables) -> DataFrame:
    p = panel(t).withColumns({**{f"lag_{k}": panels.lag(4 + k) for k in range(4)}, "season": panels.lag(52), "year_change": panels.lag(4) - panels.lag(56)})
    return p.where("year_change is not null").select("series_id", "t", "lag_0", "lag_1", "lag_2", "lag_3", "season", "year_change")


@section(f"""WITH {PANEL} SELECT series_id, t, CASE WHEN n4 = 4 THEN m4 END AS mean_4, CASE WHEN n4 = 4 THEN round(s4, 6) END AS sd_4, CASE WHEN n13 = 13 THEN round(m13, 6) END AS mean_13, CASE WHEN n13 = 13 THEN round(s13, 6) END AS sd_13 FROM (SELECT series_id, t, count(y) OVER a AS n4, avg(y) OVER a AS m4, stddev_samp(y) OVER a AS s4, count(y) OVER b AS n13, avg(y) OVER b AS m13, stddev_samp(y) OVER b AS s13
    FROM panel WINDOW a AS (PARTITION BY series_id ORDER BY t ROWS BETWEEN 7 PRECEDING AND 4 PRECEDING), b AS (PARTITION BY series_id ORDER BY t ROWS BETWEEN 16 PRECEDING AND 4 PRECEDING))""")
def e3_rolling(t: Tables) -> DataFrame:
    (m4, s4), (m13, s13) = panels.rolling(4, 4), panels.rolling(4, 13)
    return panel(t).select("series_id", "t", m4.alias("mean_4"), F.round(s4, 6).alias("sd_4"), F.round(m13, 6).alias("mean_13"), F.round(s13, 6).alias("sd_13"))


@section(f"WITH {PANEL} SELECT series_id, t, y FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY t DESC) AS r FROM panel) WHERE r <= 26")
def e4_tail(t: Tables) -> DataFrame:
    return windows.tail(panel(t), "series_id", "t", 26).select("series_id", "t", "y")


REPORTS = f"""{WEEKLY}, {CALENDAR}, weeks_ AS (SELECT year, week, CAST(row_number() OVER (ORDER BY year, week) AS INTEGER) AS t FROM calendar WHERE week <= 52),
    seen AS (SELECT DISTINCT facility, year, week FROM weekly WHERE cause = 'AF'), reports AS (SELECT s_suppkey AS facility, t, seen.facility IS NOT NULL AS reported FROM supplier CROSS JOIN weeks_ p LEFT JOIN seen ON seen.facility = s_suppkey AND seen.year = p.year AND seen.week = p.week)"""


def reports(t: Tables) -> DataFrame:
    """(facility, t, reported): every facility in every regular week, and whether it reported cause AF."""
    seen = weekly_visits(t).where("cause = 'AF'").select("facility", "year", "week").distinct().withColumn("reported", F.lit(True))
    periods = panels.time_index(calendar_table(t).where("week <= 52").select("year", "week"), ["year", "week"]).withColumn("t", F.col("t") + 1)
    full = joins.grid(t.supplier.select(F.col("s_suppkey").alias("facility")), periods, seen, ["year", "week", "facility"][::-1], zero=[])
    return full.select("facility", "t", F.coalesce("reported", F.lit(False)).alias("reported"))


@section(f"""WITH {REPORTS}, i AS (SELECT *, row_number() OVER (PARTITION BY facility ORDER BY t) - row_number() OVER (PARTITION BY facility, reported ORDER BY t) AS island, min(t) FILTER (reported) OVER (PARTITION BY facility) AS f, max(t) FILTER (reported) OVER (PARTITION BY facility) AS l FROM reports),
    p AS (SELECT facility, reported, island, count(*) AS n, min(t) AS a, max(t) AS b, any_value(f) AS f, any_value(l) AS l FROM i GROUP BY ALL)
    SELECT facility, coalesce(max(n) FILTER (reported), 0) AS longest_on, coalesce(max(n) FILTER (NOT reported), 0) AS longest_off, count(*) FILTER (NOT reported AND a > f AND b < l) AS gaps FROM p GROUP BY 1""")
def e5_runs(t: Tables) -> DataFrame:
    return windows.runs(reports(t), "facility", "t", "reported")


@section(f"""WITH {WEEKLY}, s AS (SELECT area, year * 100 + week AS period, list_sort(list(DISTINCT facility)) AS units FROM weekly GROUP BY ALL), l AS (SELECT *, lag(units) OVER (PARTITION BY area ORDER BY period) AS before FROM s) SELECT area, count(*) FILTER (before IS NOT NULL AND before <> units) AS changes FROM l GROUP BY 1""")
def e6_composition_changes(t: Tables) -> DataFrame:
    return windows.composition_changes(weekly_visits(t).withColumn("period", F.col("year") * 100 + F.col("week")), "area", "period", "facility")


ORDER_WEEKS = "ow AS (SELECT o_orderpriority AS priority, CAST(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) // 7 AS INTEGER) AS t, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY ALL)"


def order_weeks(t: Tables) -> DataFrame:
    """(priority, t, n): orders by priority and week since 1995."""
    return t.orders.groupBy(F.col("o_orderpriority").alias("priority"), F.floor(F.datediff(F.to_date("o_orderdate"), F.lit("1995-01-01")) / 7).cast("int").alias("t")).agg(F.count("*").alias("n"))


_LATE = f"""{ORDER_WEEKS}, r AS (SELECT *, quantile_cont(n, 0.5) OVER w AS med, count(*) OVER w AS k FROM ow WINDOW w AS (PARTITION BY priority ORDER BY t ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING))"""


@section(f"WITH {_LATE} SELECT priority, t, NOT bool_or(k < 8 OR n >= 0.75 * med) OVER (PARTITION BY priority ORDER BY t DESC ROWS UNBOUNDED PRECEDING) AS late FROM r")
def e7_late_weeks(t: Tables) -> DataFrame:
    return windows.flag_late_weeks(order_weeks(t), ["priority"], "t", "n").select("priority", "t", "late")


@section("""WITH d AS (SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS n FROM orders GROUP BY 1), r AS (SELECT *, quantile_cont(n, 0.5) OVER w AS med, count(*) OVER w AS k FROM d WINDOW w AS (PARTITION BY dayofweek(day) ORDER BY day ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING))
    SELECT day, n, NOT bool_or(k < 8 OR n >= 0.5 * med) OVER (ORDER BY day DESC ROWS UNBOUNDED PRECEDING) AS late FROM r""")
def e8_late_days(t: Tables) -> DataFrame:
    days = t.orders.groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count("*").alias("n"))
    return windows.flag_late_days(days, [], "day", "n").select("day", "n", "late")


@section(f"WITH {_LATE} SELECT priority, t, CASE WHEN k = 8 THEN n / med END AS completeness FROM r")
def e9_completeness(t: Tables) -> DataFrame:
    return windows.flag_late_weeks(order_weeks(t), ["priority"], "t", "n").select("priority", "t", "completeness")


@section(f"WITH {VISITS} SELECT area, sum(total) AS total FROM visits WHERE year(day) * 12 + month(day) > (SELECT max(year(day) * 12 + month(day)) - 12 FROM visits) GROUP BY 1")
def e10_last_months(t: Tables) -> DataFrame:
    return windows.last_months(visits(t), "day", 12).groupBy("area").agg(F.sum("total").alias("total"))


@section("SELECT l_suppkey, arg_min(l_partkey, (l_shipdate, l_orderkey, l_partkey)) AS first_part, arg_max(l_partkey, (l_shipdate, l_orderkey, l_partkey)) AS last_part FROM lineitem GROUP BY 1")
def e11_first_and_last(t: Tables) -> DataFrame:
    order = F.struct("l_shipdate", "l_orderkey", "l_partkey")
    return t.lineitem.groupBy("l_suppkey").agg(F.min_by("l_partkey", order).alias("first_part"), F.max_by("l_partkey", order).alias("last_part"))


_SEGMENTS = f"WITH {VISITS}, y AS (SELECT area, CAST(year(day) AS INTEGER) AS year, CASE WHEN sum(CASE WHEN cause LIKE 'A%' THEN total ELSE 0 END) * 3 >= sum(total) THEN 'many' ELSE 'few' END AS label FROM visits GROUP BY ALL)"


@section(f"{_SEGMENTS} SELECT area, label, min(year) AS from_year, max(year) AS to_year FROM (SELECT *, year - row_number() OVER (PARTITION BY area, label ORDER BY year) AS i FROM y) GROUP BY area, label, i")
def e12_segments(t: Tables) -> DataFrame:
    many = F.sum(F.when(F.col("cause").startswith("A"), F.col("total")).otherwise(0)) * 3 >= F.sum("total")
    years = visits(t).groupBy("area", F.year("day").alias("year")).agg(F.when(many, "many").otherwise("few").alias("label"))
    return windows.segments(years, "area", "year", "label")


@section("SELECT 'nation' AS kind, n_name AS name, n_regionkey AS parent FROM nation UNION ALL SELECT 'region', r_name, NULL FROM region UNION ALL SELECT 'total', 'all', NULL FROM region WHERE r_regionkey = 0")
def g1_union_of_parts(t: Tables) -> DataFrame:
    leaves = t.nation.select(F.lit("nation").alias("kind"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("parent"))
    regions = t.region.select(F.lit("region").alias("kind"), F.col("r_name").alias("name"))
    return sets.parts(leaves, regions, t.region.where("r_regionkey = 0").select(F.lit("total").alias("kind"), F.lit("all").alias("name")))


@section("""WITH a AS (SELECT DISTINCT c_nationkey + 3 AS k FROM customer), b AS (SELECT n_nationkey AS k FROM nation) SELECT k, 'missing' AS difference FROM (SELECT k FROM b EXCEPT SELECT k FROM a) UNION ALL SELECT k, 'extra' FROM (SELECT k FROM a EXCEPT SELECT k FROM b)""")
def g2_differences(t: Tables) -> DataFrame:
    return sets.differences(t.customer.select((F.col("c_nationkey") + 3).alias("k")), t.nation.select(F.col("n_nationkey").alias("k")), ["k"])


@section("SELECT l_orderkey, l_partkey, l_suppkey, l_quantity FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_partkey, l_suppkey, l_quantity) AS r FROM lineitem) WHERE r = 1")
def g3_first_per_key(t: Tables) -> DataFrame:
    return sets.first_per_key(t.lineitem, ["l_orderkey"], [F.col(c) for c in ("l_shipdate", "l_partkey", "l_suppkey", "l_quantity")]).select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity")


_SUP = f"WITH {VISITS}, s AS (SELECT s_suppkey, total FROM supplier LEFT JOIN (SELECT facility, sum(total) AS total FROM visits WHERE day < '1995-01-08' GROUP BY 1) ON facility = s_suppkey)"


@section(f"{_SUP} (SELECT *, 'top' AS side FROM s ORDER BY total DESC NULLS LAST, s_suppkey LIMIT 5) UNION ALL (SELECT *, 'bottom' FROM s ORDER BY total ASC NULLS LAST, s_suppkey LIMIT 5)")
def g4_top_and_bottom(t: Tables) -> DataFrame:
    sums = visits(t).where("day < '1995-01-08'").groupBy(F.col("facility").alias("s_suppkey")).agg(F.sum("total").alias("total"))
    return sets.top_and_bottom(t.supplier.join(sums, "s_suppkey", "left").select("s_suppkey", "total"), "total", "s_suppkey", 5)


