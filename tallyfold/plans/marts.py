"""2.9: marts and dimensions, composed of the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.functions import calendar, cleaning
from tallyfold.operators import aggregates, checks, joins, quadtree, windows
from tallyfold.plans import q_joins
from tallyfold.plans.q_expressions import monthly, stays
from tallyfold.plans.testbed import Tables, visits, weekly_visits
from tallyfold.sources import readers

CAUSES = ["AF", "AO", "NF", "NO", "RF", "RO"]


def territorial_snapshot(t: Tables) -> DataFrame:
    """One row per area with counts and the time stamp of each source."""
    key = lambda df, c: df.withColumnRenamed(c, "n_nationkey")
    customers = key(t.customer, "c_nationkey").groupBy("n_nationkey").agg(F.count("*").alias("customers"))
    suppliers = key(t.supplier, "s_nationkey").groupBy("n_nationkey").agg(F.count("*").alias("suppliers"))
    orders = key(t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")), "c_nationkey").groupBy("n_nationkey").agg(F.count("*").alias("orders"), F.max(F.to_date("o_orderdate")).alias("last_order"))
    lines = key(t.lineitem.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey")), "s_nationkey").groupBy("n_nationkey").agg(F.count("*").alias("lines"), F.max(F.to_date("l_shipdate")).alias("last_ship"))
    out = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")
    for part in (customers, suppliers, orders, lines):
        out = out.join(part, "n_nationkey", "left")
    return out.fillna(0, subset=["customers", "suppliers"])


def visit_mart(t: Tables, period: str) -> DataFrame:
    """(area, period, causes as columns, reporters, share of one cause, rate per 10,000 people), weekly or monthly."""
    v = weekly_visits(t) if period == "week" else visits(t).withColumn("month", F.trunc("day", "month"))
    keys = ["area", "year", "week"] if period == "week" else ["area", "month"]
    sums = aggregates.cause_pivot(v, keys, CAUSES)
    reporters = aggregates.distinct_reporters(v, keys, "facility")
    people = t.customer.groupBy(F.col("c_nationkey").alias("area")).agg(F.count("*").alias("people"))
    out = sums.join(reporters, keys).join(people, "area", "left")
    whole = sum(F.coalesce(f"n_{c}", F.lit(0)) for c in CAUSES)
    return out.withColumns({"total": whole, "share_AF": cleaning.ratio(F.col("n_AF"), whole), "rate": whole * 10000.0 / F.col("people")}).drop("people")


def facility_mart(t: Tables, period: str) -> DataFrame:
    """Causes as columns by facility, weekly (with one cause outside the hierarchy) or monthly."""
    if period == "week":
        return aggregates.cause_pivot(weekly_visits(t), ["facility", "year", "week"], CAUSES).withColumnRenamed("n_RO", "n_extra")
    return aggregates.cause_pivot(visits(t).withColumn("month", F.trunc("day", "month")), ["facility", "month"], CAUSES)


def supply_dimension(t: Tables) -> DataFrame:
    """(s_suppkey, core, ever_reported, last_year, included): core facilities, and others that showed activity."""
    big = F.col("l_quantity") > 49
    evidence = t.lineitem.groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.bool_or(big).alias("ever_reported"), F.max(F.when(big, F.year("l_shipdate"))).alias("last_year"))
    core = F.col("s_acctbal") > 2000
    out = t.supplier.join(evidence, "s_suppkey", "left").withColumn("ever_reported", F.coalesce("ever_reported", F.lit(False)))
    return out.select("s_suppkey", core.alias("core"), "ever_reported", "last_year", (core | (F.col("last_year") >= 2001)).alias("included"))


def bed_dimension(t: Tables) -> DataFrame:
    """(s_suppkey, beds, declared): all hospitals; beds are null where no area declares any."""
    areas = t.part.select((F.col("p_partkey") % 120).alias("s_suppkey"), F.when(F.col("p_size") > 40, F.col("p_size")).alias("beds"))
    sums = areas.where("s_suppkey % 4 <> 0").groupBy("s_suppkey").agg(F.sum("beds").alias("beds"), F.count("beds").alias("declared"))
    return t.supplier.select("s_suppkey").join(sums, "s_suppkey", "left").fillna(0, subset=["declared"])


def occupancy_mart(t: Tables) -> DataFrame:
    """Area and month with daily means, free beds and index."""
    days = F.dayofmonth(F.last_day("month"))
    m = monthly(t)
    return m.select("area", "month", "occupied", "available", days.alias("days"), (F.col("occupied") / days).alias("mean_occupied"), ((F.col("available") - F.col("occupied")) / days).alias("mean_free"), cleaning.ratio(100.0 * F.col("occupied"), F.col("available")).alias("index"))


def sparse_mart(t: Tables) -> DataFrame:
    """(priority, year, week, days, n, late): every priority in every agency week, zeros for silence, late weeks flagged."""
    daily = calendar.with_week(t.orders.where("o_totalprice > 300000").withColumn("day", F.to_date("o_orderdate")), "day")
    counts = daily.groupBy(F.col("o_orderpriority").alias("priority"), "year", "week").agg(F.count("*").alias("n"))
    span = t.orders.agg(F.min(F.to_date("o_orderdate")).alias("a"), F.max(F.to_date("o_orderdate")).alias("b"))
    weeks = calendar.weeks_of(span.select(F.explode(F.sequence("a", "b")).alias("day"))).select("year", "week", "days", "first_day")
    units = t.orders.select(F.col("o_orderpriority").alias("priority")).distinct()
    full = joins.grid(units, weeks, counts, ["priority", "year", "week"], zero=["n"])
    return windows.flag_late_weeks(full, ["priority"], "first_day", "n").select("priority", "year", "week", "days", "n", "late")


def discharge_set(t: Tables) -> DataFrame:
    """Discharges of the catalogue's priorities with resident flag, capped stay and harmonised group."""
    rows = stays(t).join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    catalogue = t.spark.createDataFrame([("1-URGENT", "high"), ("2-HIGH", "high"), ("5-LOW", "low")], "o_orderpriority string, harmonised string")
    kept = rows.join(F.broadcast(catalogue), "o_orderpriority")
    return kept.select("o_orderkey", F.year("day").alias("year"), "harmonised", F.least("days", F.lit(365)).alias("stay"), (F.col("days") > 365).alias("long_stay"), F.col("c_nationkey").alias("area"), (F.when(F.col("c_nationkey") % 6 != 0, F.col("c_nationkey")) < 10).alias("resident"))


def resident_profile(t: Tables) -> DataFrame:
    """(area, year, n, rate, median, p90, share_long): full grid, counts 0 and stays null where nobody was discharged."""
    d = discharge_set(t)
    by = d.groupBy("area", "year").agg(F.count("*").alias("n"), F.percentile("stay", F.lit(0.5)).alias("median"), F.percentile("stay", F.lit(0.9)).alias("p90"), F.avg(F.col("long_stay").cast("double")).alias("share_long"))
    people = t.customer.groupBy(F.col("c_nationkey").alias("area")).agg(F.count("*").alias("people"))
    years = t.orders.select(F.year("o_orderdate").alias("year")).distinct()
    full = joins.grid(people, years, by, ["area", "year"], zero=["n"])
    return full.withColumn("rate", F.col("n") * 10000.0 / F.col("people")).drop("people")


def bed_contrast(t: Tables) -> DataFrame:
    """(year, from_stays, from_months, ratio): bed years of two sources, for years that are complete in both."""
    stays_ = discharge_set(t).groupBy("year").agg(F.sum("stay").alias("d"))
    m = monthly(t).groupBy("month").agg(F.sum("occupied").alias("occupied")).withColumn("year", F.year("month"))
    months = aggregates.complete_years(m, [], "year", "month").join(m, "year").groupBy("year").agg(F.sum("occupied").alias("o"))
    length = calendar.year_days(F.col("year"))
    both = stays_.join(months, "year").select("year", (F.col("d") / length).alias("from_stays"), (F.col("o") / length).alias("from_months"))
    return both.withColumn("ratio", F.col("from_stays") / F.col("from_months"))


def context_mart(t: Tables) -> DataFrame:
    """Indicators of four sources in one schema; the rows of each source survive."""
    shape = lambda df, unit, value, indicator: df.select(F.col(unit).cast("string").alias("unit"), F.col(value).cast("double").alias("value"), F.lit(indicator).alias("indicator"))
    return readers.same_schema_union({
        "customer": shape(t.customer.groupBy("c_nationkey").agg(F.count("*").alias("v")), "c_nationkey", "v", "customers"), "supplier": shape(t.supplier.groupBy("s_nationkey").agg(F.count("*").alias("v")), "s_nationkey", "v", "suppliers"),
        "orders": shape(t.orders.groupBy("o_orderstatus").agg(F.count("*").alias("v")), "o_orderstatus", "v", "orders"), "part": shape(t.part.groupBy("p_brand").agg(F.max("p_size").alias("v")), "p_brand", "v", "largest"),
    })


def reporting_profile(t: Tables) -> DataFrame:
    """(facility, expected, reported, mean, sd, longest_on, longest_off, gaps): how regularly each facility reports."""
    r = q_joins.reports(t)
    run = windows.runs(r, "facility", "t", "reported")
    weekly = weekly_visits(t).where("cause = 'AF' and week <= 52").groupBy("facility", "year", "week").agg(F.sum("total").alias("n"))
    stats = weekly.groupBy("facility").agg(F.avg("n").alias("mean"), F.round(F.stddev_pop("n"), 6).alias("sd"))
    share = r.groupBy("facility").agg(F.count("*").alias("expected"), F.count_if("reported").alias("reported"))
    return share.join(run, "facility").join(stats, "facility", "left")


def resolution_list(t: Tables) -> DataFrame:
    """(vec_id, problem, in_supply, is_open, resolution, reason): what is wrong with a coordinate and what follows.

    A third of the places stand for the supply, and a fifth is closed.
    """
    p = q_joins.placed(t)
    status = joins.place_status(F.col("declared"), F.col("area"), F.col("n_inside"), F.col("n_border"), F.col("x"))
    rows = p.select("vec_id", status.alias("problem"), (F.col("vec_id") % 3 == 0).alias("in_supply"), (F.col("vec_id") % 5 != 0).alias("is_open")).where("problem <> 'match'")
    return joins.resolved(rows)


def proximity(t: Tables) -> DataFrame:
    """(area, people, median_km, p90_km, within_50): distances weighted by people, by area of 10 degrees of longitude."""
    people, all_of = q_joins.facilities(t)
    near = quadtree.nearest(people, all_of.withColumnRenamed("vec_id", "facility"), "vec_id", "facility")
    rows = people.join(near, "vec_id").select((F.col("vec_id") % 7).alias("area"), F.round("km", 6).alias("km"), "people")
    q = aggregates.weighted_quantile(rows, "area", "km", "people", [0.5, 0.9])
    share = rows.groupBy("area").agg(F.sum("people").alias("people"), (F.sum(F.when(F.col("km") <= 50, F.col("people")).otherwise(0)) / F.sum("people")).alias("within_50"))
    return share.join(q, "area").withColumnsRenamed({"q50": "median_km", "q90": "p90_km"})


def population_dimension(t: Tables) -> DataFrame:
    """(area, year, people) for the years of the orders: people who had ordered by then."""
    first = t.orders.groupBy("o_custkey").agg(F.min(F.year("o_orderdate")).alias("since"))
    years = t.orders.select(F.year("o_orderdate").alias("year")).distinct()
    since = t.customer.join(first, F.col("o_custkey") == F.col("c_custkey")).groupBy("c_nationkey", "since").agg(F.count("*").alias("n"))
    last = years.agg(F.max("year").alias("last"))
    people = since.crossJoin(F.broadcast(last)).select("c_nationkey", "n", F.explode(F.sequence("since", "last")).alias("year"))
    return people.join(years.hint("merge"), "year").groupBy(F.col("c_nationkey").alias("area"), "year").agg(F.sum("n").alias("people"))


def population_points(t: Tables) -> DataFrame:
    """Points of two layers; an id in both layers, or a weight that is missing or not positive, is a violation that is listed."""
    people, all_of = q_joins.facilities(t)
    # some weights are taken out, so that there is something to find
    weight = F.when(F.col("vec_id") % 40 == 3, F.lit(None)).when(F.col("vec_id") % 40 == 7, F.lit(0)).otherwise(F.col("people")).cast("long")
    both = people.withColumn("layer", F.lit("urban")).unionByName(all_of.where("vec_id % 10 = 0").withColumn("layer", F.lit("rural"))).unionByName(people.where("vec_id = 1").withColumn("layer", F.lit("rural")))
    both = both.withColumn("people", weight)
    twice = checks.grain(both, ["vec_id"]).select("vec_id", F.lit("shared id").alias("twice"))
    violation = F.coalesce(F.col("twice"), F.when(F.col("people").isNull(), "no weight").when(F.col("people") <= 0, "weight not positive"))
    return both.join(twice, "vec_id", "left").select("vec_id", "layer", "people", violation.alias("violation"))


def death_register(t: Tables) -> DataFrame:
    """Register rows with strict numbers, dates in several formats, tags, hashes, and how often each hash occurs."""
    key = F.col("o_orderkey")
    raw = t.orders.select("o_orderkey", F.when(key % 9 == 0, "x").otherwise((key % 130).cast("string")).alias("age"), F.when(key % 2 == 0, F.date_format("o_orderdate", "dd/MM/yyyy")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("date"), (key % 100).cast("string").alias("group"))
    day, age = cleaning.first_date(F.col("date"), ["dd/MM/yyyy", "yyyy-MM-dd"]), cleaning.bounded_int(F.col("age"), 8)
    rows = raw.select("o_orderkey", day.alias("day"), age.alias("age"), "group", F.array_join(cleaning.tags((age.isNull(), "bad_age"), (F.year(day) < 1996, "early")), ",").alias("tags"))
    hashed = readers.provenance(rows, "register", ["age", "group"])
    copies = hashed.groupBy("row_sha256").agg(F.count("*").alias("copies"))
    return hashed.join(copies, "row_sha256").select("o_orderkey", "day", "age", "tags", "copies")
