"""2.4 aggregations and 2.8 checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.functions import calendar
from tallyfold.operators import aggregates as agg
from tallyfold.operators import checks, selection
from tallyfold.plans.q_expressions import MONTHLY, STAYS, monthly, stays
from tallyfold.plans.testbed import PANEL, VISITS, WEEKLY, Section, Tables, panel, visits, weekly_visits
from tallyfold.sources import readers

section = Section()
CAUSES = ["AF", "AO", "NF", "NO", "RF", "RO"]
PIVOT = ", ".join(f"sum(total) FILTER (cause = '{c}') AS n_{c}" for c in CAUSES)


@section(f"WITH {VISITS} SELECT facility, CAST(date_trunc('month', day) AS DATE) AS month, {PIVOT} FROM visits GROUP BY ALL")
def d1_cause_pivot(t: Tables) -> DataFrame:
    return agg.cause_pivot(visits(t).withColumn("month", F.trunc("day", "month")), ["facility", "month"], CAUSES)


@section(f"WITH {VISITS} SELECT area, CAST(year(day) AS INTEGER) AS year, cause, count(DISTINCT facility) AS reporters FROM visits GROUP BY ALL")
def d2_distinct_reporters(t: Tables) -> DataFrame:
    return agg.distinct_reporters(visits(t).withColumn("year", F.year("day")), ["area", "year", "cause"], "facility")


@section("SELECT l_suppkey, sum(CASE WHEN l_suppkey % 5 <> 0 AND l_returnflag = 'A' THEN CAST(l_quantity AS BIGINT) END) AS total FROM lineitem GROUP BY 1")
def d3_sum_keeps_null(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_suppkey").agg(F.sum(F.when((F.col("l_suppkey") % 5 != 0) & (F.col("l_returnflag") == "A"), F.col("l_quantity").cast("long"))).alias("total"))


@section(f"WITH {WEEKLY}, s AS (SELECT year, week, min(day) AS week_start FROM weekly GROUP BY ALL) SELECT area, year, week, week_start, sum(total) AS total FROM weekly JOIN s USING (year, week) GROUP BY ALL")
def d4_weekly_rollup(t: Tables) -> DataFrame:
    w = weekly_visits(t)
    start = w.groupBy("year", "week").agg(F.min("day").alias("week_start"))
    return w.groupBy("area", "year", "week").agg(F.sum("total").alias("total")).join(start, ["year", "week"])


@section(f"WITH {VISITS} SELECT area, CAST(date_trunc('month', day) AS DATE) AS month, sum(total) AS total FROM visits GROUP BY ALL")
def d5_monthly_rollup(t: Tables) -> DataFrame:
    return visits(t).groupBy("area", F.trunc("day", "month").alias("month")).agg(F.sum("total").alias("total"))


@section("""WITH m AS (SELECT l_suppkey, 'disc' AS band, round(l_discount * 100) AS v FROM lineitem UNION ALL SELECT l_suppkey, 'tax', round(l_tax * 100) FROM lineitem UNION ALL SELECT l_suppkey, 'qty', l_quantity FROM lineitem)
    SELECT l_suppkey, band, CAST(sum(CAST(v AS BIGINT)) AS BIGINT) AS total FROM m GROUP BY ALL""")
def d6_melt(t: Tables) -> DataFrame:
    wide = t.lineitem.select("l_suppkey", F.round(F.col("l_discount") * 100).alias("disc"), F.round(F.col("l_tax") * 100).alias("tax"), F.col("l_quantity").alias("qty"))
    return wide.unpivot(["l_suppkey"], ["disc", "tax", "qty"], "band", "v").groupBy("l_suppkey", "band").agg(F.sum(F.col("v").cast("long")).alias("total"))


@section("""WITH n AS (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY ALL), r AS (SELECT *, n / sum(n) OVER (PARTITION BY c_nationkey) AS share, rank() OVER (PARTITION BY c_nationkey ORDER BY n DESC) AS k FROM n)
    SELECT c_nationkey, min(c_mktsegment) AS c_mktsegment, max(share) AS share, count(*) > 1 AS tie FROM r WHERE k = 1 GROUP BY 1""")
def d7_majority(t: Tables) -> DataFrame:
    return agg.majority(t.customer, "c_nationkey", "c_mktsegment")


@section("SELECT l_suppkey, bool_or(l_returnflag = 'R') AS ever_reported, bool_or(l_returnflag = 'R' AND l_quantity > 49) AS ever_positive, CAST(max(year(l_shipdate)) FILTER (l_returnflag = 'R' AND l_quantity > 49) AS INTEGER) AS last_year FROM lineitem GROUP BY 1")
def d8_presence(t: Tables) -> DataFrame:
    r, big = F.col("l_returnflag") == "R", F.col("l_quantity") > 49
    return t.lineitem.groupBy("l_suppkey").agg(F.bool_or(r).alias("ever_reported"), F.bool_or(r & big).alias("ever_positive"), F.max(F.when(r & big, F.year("l_shipdate"))).alias("last_year"))


@section("SELECT n_nationkey, count(*) FILTER (s_acctbal > 5000) AS rich, count(*) FILTER (s_acctbal <= 5000) AS poor, CASE WHEN count(s_suppkey) > 0 THEN count(*) FILTER (s_suppkey % 7 <> 0) / count(s_suppkey) END AS located FROM nation LEFT JOIN (SELECT * FROM supplier WHERE s_nationkey <> 3) ON s_nationkey = n_nationkey GROUP BY 1")
def d9_type_counts(t: Tables) -> DataFrame:
    of = t.nation.join(t.supplier.where("s_nationkey <> 3"), F.col("s_nationkey") == F.col("n_nationkey"), "left")
    n = F.count("s_suppkey")
    return of.groupBy("n_nationkey").agg(F.count_if(F.col("s_acctbal") > 5000).alias("rich"), F.count_if(F.col("s_acctbal") <= 5000).alias("poor"), F.when(n > 0, F.count_if(F.col("s_suppkey") % 7 != 0) / n).alias("located"))


@section(f"WITH {MONTHLY} SELECT area, CASE WHEN sum(available) > 0 THEN sum(occupied) / sum(available) END AS index FROM monthly GROUP BY 1")
def d10_ratio_of_sums(t: Tables) -> DataFrame:
    return monthly(t).groupBy("area").agg(agg.sum_over_sum("occupied", "available").alias("index"))


@section(f"WITH {STAYS} SELECT o_orderpriority, quantile_cont(days, 0.5) AS median, round(quantile_cont(days, 0.9), 6) AS p90, avg(CASE WHEN days > 365 THEN 1.0::DOUBLE ELSE 0 END) AS share_long FROM stays GROUP BY 1")
def d11_quantiles(t: Tables) -> DataFrame:
    s = stays(t)
    # a row for each priority
    long = s.groupBy("o_orderpriority").agg(F.avg((F.col("days") > 365).cast("double")).alias("share_long"))
    q = selection.quantiles(s, ["o_orderpriority"], "days", [0.5, 0.9])
    return long.join(F.broadcast(q), "o_orderpriority", "left").select("o_orderpriority", F.col("quantiles")[0].alias("median"), F.round(F.col("quantiles")[1], 6).alias("p90"), "share_long")


@section("""WITH w AS (SELECT p_type, p_retailprice AS v, sum(p_size) AS w FROM part GROUP BY ALL), c AS (SELECT *, sum(w) OVER (PARTITION BY p_type ORDER BY v) AS cum, sum(w) OVER (PARTITION BY p_type) AS total FROM w)
    SELECT p_type, min(v) FILTER (cum >= 0.05::DOUBLE * total) AS q05, min(v) FILTER (cum >= 0.5::DOUBLE * total) AS q50, min(v) FILTER (cum >= 0.95::DOUBLE * total) AS q95 FROM c GROUP BY 1""")
def d12_weighted_quantile(t: Tables) -> DataFrame:
    return agg.weighted_quantile(t.part, "p_type", "p_retailprice", "p_size", [0.05, 0.5, 0.95])


@section("""WITH o AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS year, o_orderstatus, o_orderpriority, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey)
    SELECT year, 'o_orderstatus' AS dimension, o_orderstatus AS category, count(*) AS n FROM o GROUP BY ALL UNION ALL SELECT year, 'o_orderpriority', o_orderpriority, count(*) FROM o GROUP BY ALL UNION ALL SELECT year, 'c_mktsegment', c_mktsegment, count(*) FROM o GROUP BY ALL""")
def d13_breakdown(t: Tables) -> DataFrame:
    rows = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).withColumn("year", F.year("o_orderdate"))
    return agg.breakdown(rows, ["year"], ["o_orderstatus", "o_orderpriority", "c_mktsegment"])


@section("""SELECT n_regionkey AS region, n_nationkey AS area, CASE WHEN grouping(n_regionkey) = 1 THEN 'total' WHEN grouping(n_nationkey) = 1 THEN 'region' ELSE 'leaf' END AS level, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ROLLUP (n_regionkey, n_nationkey)""")
def d14_levels(t: Tables) -> DataFrame:
    rows = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    level = F.when(F.grouping_id() == 3, "total").when(F.grouping_id() == 1, "region").otherwise("leaf")
    return rows.rollup(F.col("n_regionkey").alias("region"), F.col("n_nationkey").alias("area")).agg(level.alias("level"), F.count("*").alias("n"))


@section("SELECT o_custkey, CAST(year(o_orderdate) AS INTEGER) AS year FROM orders GROUP BY o_custkey, year(o_orderdate) HAVING count(DISTINCT month(o_orderdate)) >= 12 UNION ALL SELECT -1, CAST(year(o_orderdate) AS INTEGER) FROM orders GROUP BY year(o_orderdate) HAVING count(DISTINCT month(o_orderdate)) = 12")
def d15_complete_years(t: Tables) -> DataFrame:
    rows = t.orders.select("o_custkey", F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month"))
    per = agg.complete_years(rows, ["o_custkey"], "year", "month")
    return per.union(agg.complete_years(rows, [], "year", "month").select(F.lit(-1).cast("long").alias("o_custkey"), "year"))


@section(f"WITH {STAYS} SELECT CAST(year(day) AS INTEGER) AS year, sum(least(days, 365)) / dayofyear(make_date(year(day), 12, 31)) AS beds, sum(CASE WHEN o_orderpriority = '1-URGENT' THEN least(days, 365) ELSE 0 END) / dayofyear(make_date(year(day), 12, 31)) AS urgent FROM stays GROUP BY year(day)")
def d16_bed_years(t: Tables) -> DataFrame:
    rows = stays(t).select(F.year("day").alias("year"), F.least("days", F.lit(365)).alias("d"), (F.col("o_orderpriority") == "1-URGENT").alias("urgent"))
    sums = rows.groupBy("year").agg(F.sum("d").alias("d"), F.sum(F.when(F.col("urgent"), F.col("d")).otherwise(0)).alias("u"))
    length = calendar.year_days(F.col("year"))
    return sums.select("year", (F.col("d") / length).alias("beds"), (F.col("u") / length).alias("urgent"))


@section(f"WITH {MONTHLY} SELECT area, CAST(year(month) AS INTEGER) AS year, CAST(month(month) AS INTEGER) AS m, occupied, available FROM monthly")
def d17_melt_and_pivot(t: Tables) -> DataFrame:
    """From a sheet of one row per area, year and indicator with twelve month columns."""
    sheet = monthly(t).withColumns({"year": F.year("month"), "m": F.month("month").cast("string")}).unpivot(["area", "year", "m"], ["occupied", "available"], "indicator", "value").groupBy("area", "year", "indicator").pivot("m", [str(k) for k in range(1, 13)]).agg(F.first("value"))
    long = sheet.unpivot(["area", "year", "indicator"], [str(k) for k in range(1, 13)], "m", "value").where("value is not null")
    return long.groupBy("area", "year", F.col("m").cast("int").alias("m")).pivot("indicator", ["occupied", "available"]).agg(F.first("value"))


@section("SELECT p_brand, sum(CASE WHEN p_size > 45 THEN p_size END) AS beds, count(*) FILTER (p_size > 45) AS declared, count(*) AS areas FROM part GROUP BY 1")
def d18_declared_sum(t: Tables) -> DataFrame:
    beds = F.when(F.col("p_size") > 45, F.col("p_size"))
    return t.part.groupBy("p_brand").agg(F.sum(beds).alias("beds"), F.count(beds).alias("declared"), F.count("*").alias("areas"))


@section(f"WITH {WEEKLY}, w AS (SELECT year, week, sum(total) AS n FROM weekly GROUP BY ALL), y AS (SELECT year, avg(n) AS mean, quantile_cont(n, 0.5) AS median, min(n) AS least, max(n) AS most FROM w GROUP BY 1) SELECT year, sum(total) AS total, count(DISTINCT facility) AS units, count(DISTINCT day) AS days, any_value(mean) AS mean, any_value(median) AS median, any_value(least) AS least, any_value(most) AS most FROM weekly JOIN y USING (year) GROUP BY 1")
def d19_annual_activity(t: Tables) -> DataFrame:
    w = weekly_visits(t)
    weeks = w.groupBy("year", "week").agg(F.sum("total").alias("n")).groupBy("year").agg(F.avg("n").alias("mean"), F.percentile("n", F.lit(0.5)).alias("median"), F.min("n").alias("least"), F.max("n").alias("most"))
    return w.groupBy("year").agg(F.sum("total").alias("total"), F.count_distinct("facility").alias("units"), F.count_distinct("day").alias("days")).join(weeks, "year")


@section(f"WITH {VISITS}, y AS (SELECT area, CAST(year(day) AS INTEGER) AS year, CAST(sum(total) AS BIGINT) AS n FROM visits GROUP BY ALL), s AS (SELECT area, string_agg(CAST(year AS VARCHAR) || '=' || CAST(n AS VARCHAR), ',' ORDER BY year) AS by_year, CAST(sum(n) AS BIGINT) AS total FROM y GROUP BY 1) SELECT *, total / sum(total) OVER () AS share, CAST(row_number() OVER (ORDER BY total DESC, area) AS INTEGER) AS rank FROM s")
def d20_ranked_shares(t: Tables) -> DataFrame:
    ranked = agg.ranked_shares(visits(t).withColumn("year", F.year("day")), "area", "year", "total")
    listed = F.array_join(F.transform("by_year", lambda x: F.concat_ws("=", x["year"], x["total"])), ",")
    return ranked.withColumn("by_year", listed)


@section("SELECT o_orderstatus, c_mktsegment, count(*) AS n, 100.0::DOUBLE * count(*) / sum(count(*)) OVER () AS percent FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL")
def d21_cross_table(t: Tables) -> DataFrame:
    from pyspark.sql import Window as W

    n = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).groupBy("o_orderstatus", "c_mktsegment").agg(F.count("*").alias("n"))
    return n.withColumn("percent", 100.0 * F.col("n") / F.sum("n").over(W.partitionBy()))


@section("SELECT count(*) AS rows, count(*) FILTER (text IS NULL OR lang IS NULL) AS nulls, count(*) FILTER (n_chars < 0) AS negatives, count(*) FILTER (n_chars <> length(text)) AS bad_totals, count(*) - count(DISTINCT (text, lang, source)) AS extra_rows, count(DISTINCT source) AS sources FROM documents")
def d22_quality_profile(t: Tables) -> DataFrame:
    d = t.documents
    extra = agg.extra_copies(d, ["text", "lang", "source"])
    one = d.agg(F.count("*").alias("rows"), F.count_if(F.col("text").isNull() | F.col("lang").isNull()).alias("nulls"), F.count_if(F.col("n_chars") < 0).alias("negatives"), F.count_if(F.col("n_chars") != F.length("text")).alias("bad_totals"), F.count_distinct("source").alias("sources"))
    return one.crossJoin(F.broadcast(extra)).select("rows", "nulls", "negatives", "bad_totals", F.col("extra").alias("extra_rows"), "sources")


@section(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) FILTER ({c} IS NULL) AS nulls, count(*) FILTER (trim(CAST({c} AS VARCHAR)) IN ('', '*')) AS blanks, count(DISTINCT {c}) AS \"distinct\", count(*) FILTER (coalesce(TRY_CAST(CAST({c} AS VARCHAR) AS DOUBLE), 0) < 0) AS negatives FROM orders" for c in ("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority")))
def d23_source_profile(t: Tables) -> DataFrame:
    return agg.profile(t.orders, ["o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority"])


@section("WITH a AS (SELECT text, source, count(*) AS n FROM documents GROUP BY ALL), b AS (SELECT lower(trim(text)) AS x, count(*) AS n FROM documents GROUP BY ALL) SELECT (SELECT count(*) FROM a WHERE n > 1) AS raw_groups, (SELECT CAST(sum(n - 1) AS BIGINT) FROM a) AS raw_extra, (SELECT count(*) FROM b WHERE n > 1) AS groups, (SELECT CAST(sum(n - 1) AS BIGINT) FROM b) AS extra")
def d24_multiset_duplicates(t: Tables) -> DataFrame:
    raw = agg.extra_copies(t.documents, ["text", "source"]).select(F.col("groups").alias("raw_groups"), F.col("extra").alias("raw_extra"))
    return raw.crossJoin(F.broadcast(agg.extra_copies(t.documents.select(F.lower(F.trim("text")).alias("x")), ["x"])))


@section("SELECT l_returnflag, l_linestatus, CAST(year(l_shipdate) AS INTEGER) AS year, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS total, count(*) AS rows FROM lineitem GROUP BY ALL")
def d25_cause_inventory(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_returnflag", "l_linestatus", F.year("l_shipdate").alias("year")).agg(F.sum(F.col("l_quantity").cast("long")).alias("total"), F.count("*").alias("rows"))


@section(f"WITH {PANEL} SELECT series_id, avg(y) AS mean, round(stddev_samp(y), 6) AS sd, min(y) AS least, max(y) AS most, count(*) FILTER (y = 0) AS zeros, round(stddev_samp(y) / avg(y), 6) AS cv, sum(y) / sum(sum(y)) OVER () AS share FROM panel WHERE level = 'leaf' GROUP BY 1")
def d26_heterogeneity(t: Tables) -> DataFrame:
    from pyspark.sql import Window as W

    one = panel(t).where("level = 'leaf'").groupBy("series_id").agg(F.avg("y").alias("mean"), F.round(F.stddev_samp("y"), 6).alias("sd"), F.min("y").alias("least"), F.max("y").alias("most"), F.count_if(F.col("y") == 0).alias("zeros"), F.round(F.try_divide(F.stddev_samp("y"), F.avg("y")), 6).alias("cv"), F.sum("y").alias("total"))
    return one.withColumn("share", F.col("total") / F.sum("total").over(W.partitionBy())).drop("total")


@section(f"WITH {WEEKLY}, w AS (SELECT year, week, sum(total) AS n, count(DISTINCT facility) AS r FROM weekly WHERE week <= 52 GROUP BY ALL) SELECT year, CAST((week - 1) // 13 + 1 AS INTEGER) AS quarter, avg(n) AS level, avg(r) AS reporters FROM w GROUP BY ALL")
def d27_regime_profile(t: Tables) -> DataFrame:
    w = weekly_visits(t).where("week <= 52").groupBy("year", "week").agg(F.sum("total").alias("n"), F.count_distinct("facility").alias("r"))
    return w.groupBy("year", (F.floor((F.col("week") - 1) / 13) + 1).cast("int").alias("quarter")).agg(F.avg("n").alias("level"), F.avg("r").alias("reporters"))


@section("""WITH o AS (SELECT c_nationkey AS k, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderpriority = '1-URGENT' GROUP BY 1), p AS (SELECT c_nationkey AS k, count(*) AS people FROM customer GROUP BY 1),
    e AS (SELECT coalesce(n, 0) AS n, sum(coalesce(n, 0)) OVER () * people::DOUBLE / sum(people) OVER () AS expected FROM p LEFT JOIN o USING (k)) SELECT count(*) - 1 AS df, round(sum((n - expected) ** 2 / expected), 6) AS chi2, count(*) FILTER (n = 0) AS zeros, round(sum(exp(-expected)), 6) AS zeros_poisson, round(var_samp(n) / avg(n), 6) AS dispersion FROM e""")
def d28_heterogeneity_test(t: Tables) -> DataFrame:
    from pyspark.sql import Window as W

    people = t.customer.groupBy("c_nationkey").agg(F.count("*").alias("people"))
    urgent = t.orders.where("o_orderpriority = '1-URGENT'").join(t.customer, F.col("o_custkey") == F.col("c_custkey")).groupBy("c_nationkey").agg(F.count("*").alias("n"))
    every = W.partitionBy()
    e = people.join(urgent, "c_nationkey", "left").fillna(0, subset=["n"]).withColumn("expected", F.sum("n").over(every) * F.col("people") / F.sum("people").over(every))
    return e.agg((F.count("*") - 1).alias("df"), F.round(F.sum(F.pow(F.col("n") - F.col("expected"), 2) / F.col("expected")), 6).alias("chi2"), F.count_if(F.col("n") == 0).alias("zeros"), F.round(F.sum(F.exp(-F.col("expected"))), 6).alias("zeros_poisson"), F.round(F.var_samp("n") / F.avg("n"), 6).alias("dispersion"))


@section("SELECT CAST(year(o_orderdate) AS INTEGER) AS year, count(*) AS direct, count(DISTINCT o_orderkey) AS other, count(*) = count(DISTINCT o_orderkey) AS agree FROM orders GROUP BY 1")
def d30_recount(t: Tables) -> DataFrame:
    direct = t.orders.groupBy(F.year("o_orderdate").alias("year")).agg(F.count("*").alias("direct"))
    other = t.orders.select(F.date_format("o_orderdate", "yyyy").cast("int").alias("year"), "o_orderkey").distinct().groupBy("year").agg(F.count("*").alias("other"))
    return direct.join(other, "year", "full").withColumn("agree", F.col("direct").eqNullSafe(F.col("other")))


@section(f"WITH {VISITS} SELECT CAST(year(day) AS INTEGER) AS year, 100.0::DOUBLE * sum(total) FILTER (cause = 'AF') / sum(total) FILTER (cause LIKE 'A%') AS percent, count(DISTINCT facility) FILTER (cause = 'AF' AND total > 40) AS units FROM visits GROUP BY 1")
def d31_annual_ratio(t: Tables) -> DataFrame:
    af = F.col("cause") == "AF"
    sums = visits(t).groupBy(F.year("day").alias("year")).agg(F.sum(F.when(af, F.col("total"))).alias("a"), F.sum(F.when(F.col("cause").startswith("A"), F.col("total"))).alias("b"), F.count_distinct(F.when(af & (F.col("total") > 40), F.col("facility"))).alias("units"))
    return sums.select("year", (100.0 * F.col("a") / F.col("b")).alias("percent"), "units")


@section(f"""WITH {PANEL}, s AS (SELECT series_id, sum(y) / sum(sum(y)) OVER () AS share FROM panel WHERE level = 'leaf' GROUP BY 1), r AS (SELECT *, sum(share) OVER (ORDER BY share DESC, series_id ROWS UNBOUNDED PRECEDING) AS run FROM s)
    SELECT series_id, round(share, 9) AS share, round(run, 9) AS running, run - share < 0.5 AS within FROM r""")
def d32_cumulative_share(t: Tables) -> DataFrame:
    totals = panel(t).where("level = 'leaf'").groupBy("series_id").agg(F.sum("y").alias("total"))
    return agg.cumulative_share(totals, "series_id", "total", 0.5).select("series_id", F.round("share", 9).alias("share"), F.round("running", 9).alias("running"), "within")


@section("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def i1_grain(t: Tables) -> DataFrame:
    return checks.grain(t.lineitem, ["l_orderkey", "l_linenumber"])


@section("SELECT o_orderpriority AS value, count(*) AS n FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '5-LOW') GROUP BY 1")
def i2_domain(t: Tables) -> DataFrame:
    allowed = t.spark.createDataFrame([("1-URGENT",), ("2-HIGH",), ("5-LOW",)], "value string")
    return checks.domain(t.orders, "o_orderpriority", allowed)


@section("SELECT l_orderkey, l_partkey, l_quantity FROM lineitem WHERE l_quantity < 2 OR l_quantity > 49")
def i3_bounds(t: Tables) -> DataFrame:
    return checks.bounds(t.lineitem, "l_quantity", 2, 49).select("l_orderkey", "l_partkey", "l_quantity")


_HIER = f"WITH {VISITS}, h AS (SELECT facility, CAST(date_trunc('month', day) AS DATE) AS month, sum(total) FILTER (cause LIKE 'A%' OR facility % 10 = 3) AS whole, sum(total) FILTER (cause = 'AF') AS a, sum(total) FILTER (cause = 'AO') AS b FROM visits GROUP BY ALL)"


@section(f"{_HIER} SELECT * FROM h WHERE (whole IS NOT NULL AND a IS NOT NULL AND b IS NOT NULL AND a + b <> whole) OR coalesce(a > whole, false) OR coalesce(b > whole, false)")
def i4_hierarchy(t: Tables) -> DataFrame:
    pick = lambda c: F.sum(F.when(c, F.col("total")))
    cause = F.col("cause")
    h = visits(t).groupBy("facility", F.trunc("day", "month").alias("month")).agg(pick(cause.startswith("A") | (F.col("facility") % 10 == 3)).alias("whole"), pick(cause == "AF").alias("a"), pick(cause == "AO").alias("b"))
    return checks.hierarchy(h, "whole", ["a", "b"])


@section("SELECT l_suppkey, n / nullif(d, 0) AS ratio, d FROM (SELECT l_suppkey, CAST(sum(l_quantity) FILTER (l_returnflag = 'A') AS DOUBLE) AS n, CAST(sum(l_quantity) FILTER (l_returnflag <> 'A') * 0.5 AS DOUBLE) AS d FROM lineitem GROUP BY 1) WHERE n / nullif(d, 0) > 1 OR n / nullif(d, 0) < 0")
def i5_ratio_domain(t: Tables) -> DataFrame:
    a = F.col("l_returnflag") == "A"
    r = t.lineitem.groupBy("l_suppkey").agg(F.sum(F.when(a, F.col("l_quantity"))).alias("n"), (F.sum(F.when(~a, F.col("l_quantity"))) * 0.5).alias("d"))
    return checks.ratio_domain(r.withColumn("ratio", F.try_divide("n", "d")), "ratio", "d").select("l_suppkey", "ratio", "d")


@section(f"WITH {WEEKLY}, a AS (SELECT area, year, sum(total) AS l FROM weekly WHERE week <= 52 GROUP BY ALL), b AS (SELECT area, CAST(year(day) AS INTEGER) AS year, sum(total) AS r FROM visits GROUP BY ALL) SELECT area, year, l AS \"left\", r AS \"right\" FROM a FULL JOIN b USING (area, year) WHERE l IS DISTINCT FROM r")
def i6_reconcile(t: Tables) -> DataFrame:
    """Weeks without week 53 against months: the years with a fragment differ."""
    w = weekly_visits(t)
    return checks.reconcile(w.where("week <= 52"), w, ["area", "year"], "total")


@section("SELECT s_suppkey, 'coordinates' AS rule FROM supplier WHERE s_suppkey % 11 = 0 AND s_suppkey % 2 = 1 UNION ALL SELECT s_suppkey, 'year' FROM supplier WHERE s_suppkey % 13 = 0")
def i7_iff_rules(t: Tables) -> DataFrame:
    k = F.col("s_suppkey")
    rows = t.supplier.withColumns({"lat": F.when(k % 11 != 0, 1.0), "lon": F.when((k % 11 != 0) | (k % 2 == 1), 1.0), "reported": k % 13 != 0, "last_year": F.lit(2000)})
    return checks.rules(rows, "s_suppkey", {"coordinates": checks.both_or_none("lat", "lon"), "year": F.col("reported") == F.col("last_year").isNotNull()})


@section("SELECT n_nationkey, 'silent' AS rule FROM nation WHERE n_nationkey % 6 = 0")
def i8_null_is_not_zero(t: Tables) -> DataFrame:
    k = F.col("n_nationkey")
    rows = t.nation.withColumns({"reported": k % 3 != 0, "total": F.when(k % 3 != 0, k).when(k % 6 == 0, 0)})
    return checks.rules(rows, "n_nationkey", {"silent": checks.null_iff_silent(F.col("reported"), ["total"])})


@section("SELECT vec_id, 'rising' AS rule FROM embeddings WHERE embedding[1] > embedding[2] OR embedding[2] > embedding[3]")
def i9_monotone(t: Tables) -> DataFrame:
    e = t.embeddings.select("vec_id", *(F.col("embedding")[k].alias(f"x{k}") for k in range(3)))
    return checks.rules(e, "vec_id", {"rising": checks.ascending("x0", "x1", "x2")})


@section("SELECT l_suppkey, detail, published, n FROM (SELECT l_suppkey, sum(l_quantity) AS detail, count(*) AS n, sum(l_quantity) + CASE WHEN l_suppkey % 10 = 0 THEN 0.01::DOUBLE * count(*) WHEN l_suppkey % 10 = 1 THEN 0.001::DOUBLE * count(*) ELSE 0 END AS published FROM lineitem GROUP BY 1) WHERE l_suppkey % 10 = 0")
def i10_published_totals(t: Tables) -> DataFrame:
    k = F.col("l_suppkey")
    off = F.when(k % 10 == 0, 0.01 * F.count("*")).when(k % 10 == 1, 0.001 * F.count("*")).otherwise(0)
    published = t.lineitem.groupBy("l_suppkey").agg((F.sum("l_quantity") + off).alias("l_quantity"))
    return checks.published_totals(t.lineitem, published, ["l_suppkey"], "l_quantity").select("l_suppkey", "detail", "published", "n")


@section(f"WITH {VISITS}, h AS (SELECT facility, CAST(date_trunc('month', day) AS DATE) AS month, sum(total) AS whole, sum(total) FILTER (cause LIKE 'A%') AS a, sum(total) FILTER (cause LIKE 'N%' AND facility % 8 <> 1) AS b, sum(total) FILTER (cause LIKE 'R%') AS c FROM visits GROUP BY ALL) SELECT * FROM h WHERE whole <> coalesce(a, 0) + coalesce(b, 0) + coalesce(c, 0)")
def i11_row_sums(t: Tables) -> DataFrame:
    pick = lambda c: F.sum(F.when(c, F.col("total")))
    cause = F.col("cause")
    h = visits(t).groupBy("facility", F.trunc("day", "month").alias("month")).agg(F.sum("total").alias("whole"), pick(cause.startswith("A")).alias("a"), pick(cause.startswith("N") & (F.col("facility") % 8 != 1)).alias("b"), pick(cause.startswith("R")).alias("c"))
    return checks.row_sums(h, "whole", ["a", "b", "c"])


@section(f"WITH {MONTHLY} SELECT area, month, 'identity' AS rule FROM monthly WHERE abs(floor(occupied / day(last_day(month)) * 100) / 100 - occupied / day(last_day(month))) > 0.005")
def i12_identity(t: Tables) -> DataFrame:
    """Published means that were cut instead of rounded break the tolerance."""
    days = F.dayofmonth(F.last_day("month"))
    m = monthly(t).withColumn("published", F.floor(F.col("occupied") / days * 100) / 100)
    bad = m.where(F.abs(F.col("published") - F.col("occupied") / days) > 0.005)
    return bad.select("area", "month", F.lit("identity").alias("rule"))


@section(f"WITH {MONTHLY}, p AS (SELECT *, CAST(year(month) AS INTEGER) AS year, CASE WHEN year(month) < 1999 THEN 100.0::DOUBLE * occupied / available ELSE 100.0::DOUBLE * (available - occupied) / available END AS published FROM monthly) SELECT year, 'occupied' AS formula, count(*) AS n, avg(CASE WHEN abs(100.0::DOUBLE * occupied / available - published) <= 0.01 THEN 1.0::DOUBLE ELSE 0 END) AS fit FROM p GROUP BY ALL UNION ALL SELECT year, 'free', count(*), avg(CASE WHEN abs(100.0::DOUBLE * (available - occupied) / available - published) <= 0.01 THEN 1.0::DOUBLE ELSE 0 END) FROM p GROUP BY ALL")
def i13_formula_discovery(t: Tables) -> DataFrame:
    used, free = 100.0 * F.col("occupied") / F.col("available"), 100.0 * (F.col("available") - F.col("occupied")) / F.col("available")
    m = monthly(t).withColumn("year", F.year("month")).withColumn("published", F.when(F.col("year") < 1999, used).otherwise(free))
    return checks.formula_fit(m, "published", {"occupied": used, "free": free}, ["year"], 0.01)


@section("""SELECT 'missing' AS "column", 'int' AS expected, NULL::VARCHAR AS found UNION ALL SELECT 'o_orderdate', 'text', 'timestamp_ntz' FROM (SELECT 1 FROM orders LIMIT 1)""")
def i14_schema_contract(t: Tables) -> DataFrame:
    contract = checks.Contract({"o_orderkey": "int", "o_totalprice": "float", "o_orderstatus": "text", "o_orderdate": "text", "missing": "int"}, ["o_orderkey"], ["o_orderstatus"])
    return contract.schema_violations(t.orders, t.spark)


@section("WITH s AS (SELECT o_custkey % 500 AS series_id, CAST(year(o_orderdate) * 12 + month(o_orderdate) AS INTEGER) AS p FROM orders GROUP BY ALL), g AS (SELECT series_id, count(*) AS n, min(p) AS a, max(p) AS b FROM s GROUP BY 1) SELECT * FROM g WHERE n <> (SELECT max(n) FROM g) OR a <> (SELECT min(a) FROM g) OR b <> (SELECT max(b) FROM g)")
def i15_regular_grid(t: Tables) -> DataFrame:
    s = t.orders.select((F.col("o_custkey") % 500).alias("series_id"), (F.year("o_orderdate") * 12 + F.month("o_orderdate")).alias("p")).distinct()
    return checks.regular_grid(s, "series_id", "p")


@section("SELECT n_regionkey, s_name, count(*) AS n FROM (SELECT n_regionkey, s_name FROM supplier JOIN nation ON s_nationkey = n_nationkey UNION ALL SELECT n_regionkey, s_name FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey % 9 = 0) GROUP BY ALL HAVING count(*) > 1")
def i16_repeats(t: Tables) -> DataFrame:
    rows = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).select("n_regionkey", "s_name", "s_suppkey")
    return checks.repeats(rows.union(rows.where("s_suppkey % 9 = 0")), "s_name", ["n_regionkey"])


@section("SELECT DISTINCT 'orders' AS input, 'changed' AS reason FROM orders WHERE o_orderkey = (SELECT min(o_orderkey) FROM orders) UNION ALL SELECT 'region', 'gone' UNION ALL SELECT 'supplier', 'new'")
def i17_freshness(t: Tables) -> DataFrame:
    tag = lambda name, df: readers.fingerprint(df).select(F.lit(name).alias("input"), F.col("xor_hash").alias("fingerprint"))
    old = tag("orders", t.orders).union(tag("nation", t.nation)).union(tag("region", t.region))
    now = tag("orders", t.orders.join(F.broadcast(t.orders.agg(F.min("o_orderkey").alias("o_orderkey"))), "o_orderkey", "left_anti").select(*t.orders.columns)).union(tag("nation", t.nation)).union(tag("supplier", t.supplier))
    return checks.freshness(old, now)


@section(f"WITH {WEEKLY}, o AS (SELECT CAST(o_orderdate AS DATE) AS day FROM orders), c AS (SELECT 'visits' AS product, max(year * 100 + week) AS cutoff FROM weekly UNION ALL SELECT 'area_1', max(year * 100 + week) FROM weekly WHERE day < DATE '2001-06-01') SELECT * FROM c WHERE (SELECT count(DISTINCT cutoff) FROM c) > 1")
def i18_cutoffs(t: Tables) -> DataFrame:
    w = weekly_visits(t)
    return checks.misaligned_cutoffs({"visits": w, "area_1": w.where("day < '2001-06-01'")})


@section("WITH own AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS year, count(*) AS n FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1), ref AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS year, count(*) AS n FROM orders GROUP BY 1) SELECT year, ref.n AS reference, own.n AS own, coalesce(own.n, 0) - ref.n AS difference FROM ref LEFT JOIN own USING (year)")
def i19_reference_compare(t: Tables) -> DataFrame:
    by_year = lambda df: df.groupBy(F.year("o_orderdate").alias("year")).agg(F.count("*").alias("n"))
    return checks.compare_reference(by_year(t.orders.where("o_orderstatus <> 'P'")), by_year(t.orders), ["year"], "n")
