"""2.1: sources and ingestion."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyfold.functions import cleaning
from tallyfold.plans.testbed import Section, Tables, sql_fields
from tallyfold.sources import publish, readers, shared

section = Section()


def _shared(t: Tables, name: str) -> str:
    """A new path in the folder that driver and executors share."""
    return f"{shared.shared_dir(t.spark)}/{name}-{uuid.uuid4().hex}"


@section("""SELECT CAST(year(l_shipdate) AS INTEGER) AS year, l_returnflag, count(*) AS n, sum(CAST(l_quantity AS BIGINT)) AS total FROM lineitem GROUP BY ALL""")
def a1_delimited_scan(t: Tables) -> DataFrame:
    path = _shared(t, "delimited")
    rows = t.lineitem.select(F.year("l_shipdate").alias("year"), "l_returnflag", F.col("l_quantity").cast("long").alias("total"))
    paths = {}
    for name, keep in (("old", F.col("year") < 1999), ("new", F.col("year") >= 1999)):
        paths[1998 if name == "old" else 1999] = f"{path}/{name}"
        rows.where(keep).write.csv(f"{path}/{name}", sep=";", header=True, encoding="ISO-8859-1" if name == "old" else "UTF-8")
    schema = T.StructType([T.StructField("year", T.IntegerType()), T.StructField("l_returnflag", T.StringType()), T.StructField("total", T.LongType())])
    back = readers.delimited(t.spark, paths, schema, last_latin_year=1998)
    return back.groupBy("year", "l_returnflag").agg(F.count("*").alias("n"), F.sum("total").alias("total"))


@section("SELECT o_orderkey, o_orderpriority AS priority FROM orders")
def a2_header_alias(t: Tables) -> DataFrame:
    short = t.orders.withColumnRenamed("o_orderpriority", "o_orderprior")
    return short.select("o_orderkey", cleaning.alias_of(short, "o_orderpriority", "o_orderprior").alias("priority"))


@section("""SELECT event_id, CAST(trunc(TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE)) AS BIGINT) AS strict,
    coalesce(CAST(trunc(TRY_CAST(nullif(json_extract_string(props, '$.k'), '7') AS DOUBLE)) AS BIGINT), 0) AS lenient FROM events""")
def a3_tolerant_int(t: Tables) -> DataFrame:
    k = F.get_json_object("props", "$.k")
    texts = t.events.select("event_id", F.concat(k, F.lit(".0")).alias("k"), F.when(k != "7", k).otherwise(" ").alias("j"))
    return texts.select("event_id", cleaning.tolerant_int(F.col("k")).alias("strict"), cleaning.tolerant_int(F.col("j"), 0).alias("lenient"))


@section("""SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey * 3 BETWEEN -32768 AND 32767 THEN o_orderkey * 3 END AS small,
    CASE WHEN o_orderkey % 7 <> 0 AND o_orderkey * 3 > 32767 THEN 'bad_key' END AS exception FROM orders""")
def a4_bounded_int(t: Tables) -> DataFrame:
    text = F.when(F.col("o_orderkey") % 7 != 0, (F.col("o_orderkey") * 3).cast("string")).otherwise("")
    return t.orders.select("o_orderkey", cleaning.bounded_int(text, 16).alias("small"), cleaning.int_exception(text, "key", 16).alias("exception"))


@section("SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 4 THEN CAST(o_orderdate AS DATE) END AS day FROM orders")
def a5_first_date(t: Tables) -> DataFrame:
    k = F.col("o_orderkey") % 5
    text = F.when(k == 0, F.date_format("o_orderdate", "dd/MM/yyyy")).when(k == 1, F.date_format("o_orderdate", "yyyy-MM-dd")).when(k == 4, "31/31/1999").otherwise(F.date_format("o_orderdate", "yyyyMMdd"))
    return t.orders.select("o_orderkey", cleaning.first_date(text, ["dd/MM/yyyy", "yyyy-MM-dd", "yyyyMMdd"]).alias("day"))


@section("SELECT l_orderkey, l_suppkey, CAST(l_quantity AS BIGINT) AS total FROM lineitem WHERE l_returnflag IN ('A', 'R') AND l_suppkey = 5 AND l_linestatus LIKE 'F%'")
def a6_projected_scan(t: Tables) -> DataFrame:
    keep = F.col("l_returnflag").isin("A", "R") & (F.col("l_suppkey") == 5) & F.col("l_linestatus").startswith("F")
    return readers.scan(t.lineitem, ["l_orderkey", "l_suppkey", "l_quantity"], keep).select("l_orderkey", "l_suppkey", F.col("l_quantity").cast("long").alias("total"))


@section("SELECT CAST(year(o_orderdate) AS INTEGER) AS source_year, count(*) AS n, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY 1")
def a7_yearly_union(t: Tables) -> DataFrame:
    # one row per year
    years = sorted(r[0] for r in t.orders.select(F.year("o_orderdate")).distinct().collect())
    parts = {y: t.orders.where((F.col("o_orderdate") >= f"{y}-01-01") & (F.col("o_orderdate") < f"{y + 1}-01-01")) for y in years}
    return readers.yearly_union(parts, years).groupBy("source_year").agg(F.count("*").alias("n"), F.count_distinct("o_custkey").alias("customers"))


@section("""SELECT 'events' AS source, count(*) AS n, min(CAST(ts AS DATE)) AS first_day, max(CAST(ts AS DATE)) AS last_day FROM events
    UNION ALL SELECT 'orders', count(*), min(CAST(o_orderdate AS DATE)), max(CAST(o_orderdate AS DATE)) FROM orders""")
def a8_same_schema_union(t: Tables) -> DataFrame:
    both = {
        "orders": t.orders.select(F.col("o_orderkey").alias("id"), F.to_date("o_orderdate").alias("day"), F.col("o_totalprice").alias("value")),
        "events": t.events.select(F.col("event_id").alias("id"), F.to_date("ts").alias("day"), "value"),
    }
    return readers.same_schema_union(both).groupBy("source").agg(F.count("*").alias("n"), F.min("day").alias("first_day"), F.max("day").alias("last_day"))


_SNAPSHOTS = "SELECT *, CAST(year(o_orderdate) AS INTEGER) AS year, CASE WHEN year(o_orderdate) >= 1999 THEN CAST(o_orderkey % 3 AS INTEGER) ELSE 0 END AS snap, CASE WHEN year(o_orderdate) = 2001 AND o_orderkey % 2 = 0 THEN 'b' ELSE 'a' END AS src FROM orders"


@section(f"""WITH s AS ({_SNAPSHOTS}), n AS (SELECT year, max(snap) AS m, count(DISTINCT src) > 1 AS source_conflict FROM s GROUP BY year)
    SELECT year, snap, source_conflict, count(*) AS n FROM s JOIN n USING (year) WHERE snap = m GROUP BY ALL""")
def a9_latest_snapshot(t: Tables) -> DataFrame:
    year = F.year("o_orderdate")
    rows = t.orders.select("o_orderkey", year.alias("year"), F.when(year >= 1999, (F.col("o_orderkey") % 3).cast("int")).otherwise(0).alias("snap"), F.when((year == 2001) & (F.col("o_orderkey") % 2 == 0), "b").otherwise("a").alias("src"))
    return readers.latest_snapshot(rows, ["year"], "snap", "src").groupBy("year", "snap", "source_conflict").agg(F.count("*").alias("n"))


@section("""SELECT o_orderkey, 'orders' AS source_id, sha256(""" + sql_fields("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority") + """) AS row_sha256 FROM orders""")
def a10_row_provenance(t: Tables) -> DataFrame:
    return readers.provenance(t.orders, "orders", ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"]).select("o_orderkey", "source_id", "row_sha256")


@section(f"WITH h AS (SELECT CAST('0x' || substr(sha256({sql_fields('o_orderkey', 'o_custkey', 'o_orderstatus', 'o_totalprice', 'o_orderdate', 'o_orderpriority')}), 1, 15) AS BIGINT) AS h FROM orders) SELECT count(*) AS rows, bit_xor(h) AS xor_hash, CAST(sum(h) AS VARCHAR) AS sum_hash FROM h")
def a11_fingerprint(t: Tables) -> DataFrame:
    rows = t.orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
    return readers.fingerprint(rows).withColumn("sum_hash", F.col("sum_hash").cast("string"))


@section("WITH m AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS year, o_orderstatus, count(*) AS n FROM orders GROUP BY ALL) SELECT *, CAST(sum(n) OVER (PARTITION BY year) AS BIGINT) AS whole FROM m")
def a12_validated_publish(t: Tables) -> DataFrame:
    """Two tables that readers see together: a failed check of one would leave both as they were."""
    mart = t.orders.groupBy(F.year("o_orderdate").alias("year"), "o_orderstatus").agg(F.count("*").alias("n"))
    years = t.orders.groupBy(F.year("o_orderdate").alias("year")).agg(F.count("*").alias("whole"))
    twice = lambda keys: lambda df: df.groupBy(*keys).count().where("count > 1")
    checks = {"grain": twice(["year", "o_orderstatus"]), "negative": lambda df: df.where("n < 0")}
    put = publish.publish_together(_shared(t, "marts"), {"by_status": (mart, checks), "by_year": (years, {"grain": twice(["year"])})}, {"by_status": ["year"]})
    return put["by_status"].join(put["by_year"], "year").select("year", "o_orderstatus", "n", "whole")


@section("""WITH c AS (SELECT 'text' AS "column", text AS value FROM documents UNION ALL SELECT 'source', source FROM documents),
    v AS (SELECT "column", value, count(*) AS n FROM c WHERE regexp_matches(value, '[ÃÂçé]') GROUP BY ALL),
    r AS (SELECT *, CAST(row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value) AS INTEGER) AS rank, CAST(sum(n) OVER (PARTITION BY "column") AS BIGINT) AS affected, count(*) OVER (PARTITION BY "column") AS "distinct" FROM v)
    SELECT "column", affected, "distinct", rank, value, n FROM r WHERE rank <= 20""")
def a13_encoding_audit(t: Tables) -> DataFrame:
    """The test texts hold no broken letters, so accented ones stand in for them."""
    return readers.encoding_audit(t.documents, ["text", "source"], "[ÃÂçé]")


@section("SELECT o_orderkey AS order_key, o_custkey AS customer_key_id FROM orders")
def a14_snake_names(t: Tables) -> DataFrame:
    return cleaning.snake_names(t.orders.select(F.col("o_orderkey").alias("OrderKey"), F.col("o_custkey").alias("Customer key (ID)")))


@section("""SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS block FROM conversations""")
def a15_fill_down(t: Tables) -> DataFrame:
    return readers.fill_down(t.conversations, "conv_id", "turn", F.when(F.col("role") == "user", F.col("turn")), "block").select("conv_id", "turn", "block")


@section("""SELECT row_kind, count(*) AS n, CAST(sum(total) AS BIGINT) AS total FROM (
    SELECT CASE WHEN grouping(l_returnflag) = 1 THEN 'country' WHEN grouping(l_suppkey) = 1 THEN 'service' ELSE 'detail' END AS row_kind, sum(CAST(l_quantity AS BIGINT)) AS total
    FROM lineitem GROUP BY ROLLUP (l_returnflag, l_suppkey)) GROUP BY 1""")
def a16_row_classifier(t: Tables) -> DataFrame:
    sheet = t.lineitem.rollup("l_returnflag", "l_suppkey").agg(F.sum(F.col("l_quantity").cast("long")).alias("total"))
    kind = cleaning.first_label([(F.col("l_returnflag").isNull(), "country"), (F.col("l_suppkey").isNull(), "service"), (F.col("total").isNotNull(), "detail")])
    return sheet.withColumn("row_kind", kind).groupBy("row_kind").agg(F.count("*").alias("n"), F.sum("total").alias("total"))


@section("""SELECT conv_id, turn FROM (SELECT conv_id, turn, max(CASE WHEN role = 'assistant' THEN turn END) OVER (PARTITION BY conv_id) AS m FROM conversations) WHERE turn <= m""")
def a17_footnote_cut(t: Tables) -> DataFrame:
    return readers.until_last(t.conversations, "conv_id", "turn", F.col("role") == "assistant").select("conv_id", "turn")


@section("""SELECT l_orderkey, l_linenumber, 'all' AS sex, 'quantity' AS indicator, 'units' AS unit, l_quantity AS value FROM lineitem
    UNION ALL SELECT l_orderkey, l_linenumber, 'all', 'discount', 'share', l_discount FROM lineitem
    UNION ALL SELECT l_orderkey, l_linenumber, 'none', 'tax', 'share', l_tax FROM lineitem""")
def a18_column_definitions(t: Tables) -> DataFrame:
    definitions = t.spark.createDataFrame([("l_quantity", "all", "quantity", "units"), ("l_discount", "all", "discount", "share"), ("l_tax", "none", "tax", "share")], "column string, sex string, indicator string, unit string")
    return readers.to_long(t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax"), ["l_orderkey", "l_linenumber"], definitions)


@section("""SELECT event_id, CASE WHEN event_id % 4 <> 0 THEN CAST(json_extract_string(props, '$.k') AS DOUBLE) END AS value, CASE WHEN event_id % 4 = 0 THEN '-' END AS value_text FROM events""")
def a19_value_or_symbol(t: Tables) -> DataFrame:
    value, text = cleaning.value_or_symbol(F.when(F.col("event_id") % 4 == 0, "-").otherwise(F.get_json_object("props", "$.k")))
    return t.events.select("event_id", value.alias("value"), text.alias("value_text"))


@section("""SELECT p_partkey, CASE WHEN p_size % 6 > 2 THEN CAST(p_size AS BIGINT) END AS beds, p_size % 6 = 2 AS bad FROM part""")
def a20_bed_cell(t: Tables) -> DataFrame:
    k = F.col("p_size") % 6
    value, bad = cleaning.bed_cell(F.when(k == 0, "").when(k == 1, "*****").when(k == 2, "n/d").otherwise(F.col("p_size").cast("string")))
    return t.part.select("p_partkey", value.alias("beds"), bad.alias("bad"))


CAUSES = [("A", "accepted", True), ("N", "none", True), ("R", "returned", False)]


@section("""WITH c(cause, label, exclusive) AS (VALUES ('A', 'accepted', true), ('N', 'none', true), ('R', 'returned', false))
    SELECT cause, label, exclusive, count(*) AS n FROM c JOIN lineitem ON cause = l_returnflag GROUP BY ALL""")
def a21_literal_catalogue(t: Tables) -> DataFrame:
    catalogue = t.spark.createDataFrame(CAUSES, "cause string, label string, exclusive boolean")
    return t.lineitem.join(F.broadcast(catalogue), F.col("cause") == F.col("l_returnflag")).groupBy("cause", "label", "exclusive").agg(F.count("*").alias("n"))


@section("SELECT CAST(year(l_shipdate) AS INTEGER) AS year, min(CAST(l_shipdate AS DATE)) AS first_day, max(CAST(l_shipdate AS DATE)) AS last_day FROM lineitem GROUP BY 1")
def a22_date_bounds(t: Tables) -> DataFrame:
    first, last = readers.date_bounds(F.col("text"))
    return t.lineitem.select(F.year("l_shipdate").alias("year"), F.date_format("l_shipdate", "dd/MM/yyyy").alias("text")).groupBy("year").agg(first.alias("first_day"), last.alias("last_day"))


@section("SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1")
def a23_refresh(t: Tables) -> DataFrame:
    """Events by day as a file stream: each batch rewrites the days it touches."""
    from tallyfold.streaming import refresh

    source, target = _shared(t, "events"), _shared(t, "events-by-day")
    t.events.select(F.to_date("ts").alias("day"), "event_id").write.parquet(source)
    refresh.by_period(t.spark, source, target, _shared(t, "refresh-state"), "day date, event_id long", "day")
    return refresh.current(t.spark, target, "day date, event_id long").groupBy("day").agg(F.count("*").alias("n"))


@section("SELECT 'orders' AS source_id, 'https://example.org/orders' AS url, count(*) AS rows FROM orders")
def a24_provenance_log(t: Tables) -> DataFrame:
    return publish.record_snapshot(_shared(t, "log"), "orders", "https://example.org/orders", t.orders).select("source_id", "url", "rows")


@section("""WITH y AS (SELECT c_nationkey AS area, 2001 AS year, CAST(floor(c_acctbal / 100) AS BIGINT) AS people FROM customer UNION ALL SELECT c_nationkey, 2002, CAST(floor(c_acctbal / 50) AS BIGINT) FROM customer)
    SELECT area, CAST(year AS INTEGER) AS year, CAST(sum(people) AS BIGINT) AS people FROM y GROUP BY ALL""")
def a25_population_scan(t: Tables) -> DataFrame:
    wide = t.customer.select(F.col("c_nationkey").alias("area"), F.floor(F.col("c_acctbal") / 100).alias("2001"), F.floor(F.col("c_acctbal") / 50).alias("2002"))
    return wide.unpivot(["area"], ["2001", "2002"], "year", "people").groupBy("area", F.col("year").cast("int").alias("year")).agg(F.sum("people").alias("people"))


