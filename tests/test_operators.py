import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from tallyfold.functions import cleaning
from tallyfold.operators import aggregates, capacity, checks, evaluate, intervals, joins, models, panels, reconcile, serve, windows
from tallyfold.sources import publish, readers


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_cleaning(spark):
    df = spark.createDataFrame([("  a   b * ",), ("nan",), ("12.0",), ("x",), ("-33,4",), (None,)], "t string")
    got = [tuple(r) for r in df.select(cleaning.clean_text(F.col("t")), cleaning.tolerant_int(F.col("t"), 0), cleaning.comma_number(F.col("t"))).collect()]
    assert got == [("a b", 0, None), (None, 0, None), ("12.0", 12, 12.0), ("x", 0, None), ("-33,4", 0, -33.4), (None, 0, None)]
    name, year = cleaning.newest_column(["id", "beds_2013", "beds_2014*"], "beds_")
    assert (name, year) == ("beds_2014*", 2014)


def test_absent_cause_is_null(spark):
    df = spark.createDataFrame([(1, "A", 4), (1, "B", 0)], "k int, cause string, total long")
    assert aggregates.cause_pivot(df, ["k"], ["A", "B", "C"]).first()[1:] == (4, 0, None)


def test_weighted_quantile(spark):
    df = spark.createDataFrame([(1, 1, 10), (1, 5, 80), (1, 9, 10)], "g int, v int, w int")
    r = aggregates.weighted_quantile(df, "g", "v", "w", [0.05, 0.5, 0.95]).first()
    assert (r["q05"], r["q50"], r["q95"]) == (1, 5, 9)


def test_late_flag_marks_only_the_end(spark):
    n = [100] * 10 + [20] + [100] * 10 + [30, 10]
    df = spark.createDataFrame([("x", i, v) for i, v in enumerate(n)], "k string, t int, n int")
    late = {r.t for r in windows.flag_late_weeks(df, ["k"], "t", "n").where("late").collect()}
    assert late == {21, 22}


def test_runs(spark):
    on = [False, True, True, False, False, True, False]
    df = spark.createDataFrame([("x", i, v) for i, v in enumerate(on)], "k string, t int, r boolean")
    assert tuple(windows.runs(df, "k", "t", "r").first()) == ("x", 2, 2, 1)


def test_lookup_refuses_repeated_keys(spark):
    left, right = spark.createDataFrame([(1,)], "k int"), spark.createDataFrame([(1, "a"), (1, "b")], "k int, v string")
    with pytest.raises(Exception, match="twice"):
        joins.lookup(left, right, ["k"]).collect()


def test_border_points_are_ambiguous(spark):
    ring = [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0), (0.0, 0.0)]
    areas = spark.createDataFrame([(1, ring), (2, [(x + 2.0, y) for x, y in ring])], "area int, ring array<struct<x:double,y:double>>")
    points = spark.createDataFrame([(1, 1.0, 1.0), (2, 2.0, 1.0), (3, 9.0, 9.0), (4, None, None)], "p int, x double, y double")
    found = joins.points_in_areas(points, joins.edges(areas, "ring", "area"), "p", "area", 1.5).withColumn("declared", F.lit(1))
    status = joins.place_status(F.col("declared"), F.col("area"), F.col("n_inside"), F.col("n_border"), F.col("x"))
    assert rows(found.select("p", status)) == [(1, "match"), (2, "ambiguous"), (3, "outside"), (4, "no_coordinates")]


def test_bed_scenario(spark):
    months = [dt.date(2025, m, 1) for m in range(1, 13)]
    days = [31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31]
    full = [(1, d, 18 * k if d.month == 6 else 10 * k, 20 * k) for d, k in zip(months, days)]
    df = spark.createDataFrame(full + [(2, *x[1:]) for x in full[1:]], "u int, month date, occupied long, available long")
    beds = spark.createDataFrame([(1, 21.0), (2, None)], "u int, declared double")
    got = {r.u: r for r in capacity.bed_scenario(df, "u", beds, "2026-01-15").collect()}
    assert (got[1].reason, got[1].target, got[1].target_tight, got[1].gap, got[1].increase) == (None, 22, 20, 2.0, 1)
    assert got[2].reason == "missing months" and got[2].target is None


def test_grain_and_rules(spark):
    df = spark.createDataFrame([(1, 5), (1, 6), (None, 7)], "k int, v int")
    assert checks.grain(df, ["k"]).count() == 2
    assert rows(checks.rules(df.where("k = 1"), "k", {"small": F.col("v") < 6})) == [(1, "small")]


def test_largest_remainder_adds_up(spark):
    df = spark.createDataFrame([("g", "a", 1), ("g", "b", 1), ("g", "c", 1)], "g string, c string, w long")
    got = serve.largest_remainder(df, "g", "c", "w", 100).collect()
    assert sorted(r.allocated for r in got) == [33, 33, 34]


@pytest.fixture(scope="module")
def panel(spark):
    data = [(f"A{a:02d}", "leaf", a % 2, t, 1996 + t // 52, t % 52 + 1, int(50 + 10 * a + 20 * math.sin(t / 8) + (t * (a + 3)) % 7)) for a in range(4) for t in range(240)]
    leaves = spark.createDataFrame(data, "series_id string, level string, service int, t int, year int, week int, y long")
    up = leaves.groupBy("service", "t", "year", "week").agg(F.sum("y").alias("y")).select(F.concat(F.lit("S"), F.col("service")).alias("series_id"), F.lit("service").alias("level"), "service", "t", "year", "week", "y")
    top = leaves.groupBy("t", "year", "week").agg(F.sum("y").alias("y")).select(F.lit("TOTAL").alias("series_id"), F.lit("total").alias("level"), F.lit(None).cast("int").alias("service"), "t", "year", "week", "y")
    return leaves.unionByName(up).unionByName(top).cache()


def test_reconciled_forecasts_add_up(panel):
    back = models.backtest(panel, ["naive", "drift"], [1, 4], n=2)
    rough = models.level_hybrid(back, "drift", "naive").withColumn("y_pred", F.when(F.col("level") == "service", F.col("y_pred") * 1.2).otherwise(F.col("y_pred")))
    keys = ["model", "origin", "horizon"]
    for f in (reconcile.bottom_up, reconcile.top_down, reconcile.middle_out, reconcile.structural):
        gap = reconcile.coherence_gap(f(rough, keys), keys)
        assert gap.count() == 4 and gap.agg(F.max(F.abs("gap"))).first()[0] < 1e-6, f.__name__


def test_predictions_do_not_see_the_future(panel):
    at = models.origins(panel, 8, 1, 4)
    origin = at.first()[0]
    changed = panel.withColumn("y", F.when(F.col("t") > origin, F.col("y") + 1000).otherwise(F.col("y")))
    for m in (models.naive, models.drift):
        assert rows(m(panel, at, [1, 4]).select("series_id", "horizon", "y_pred", "lo", "hi")) == rows(m(changed, at, [1, 4]).select("series_id", "horizon", "y_pred", "lo", "hi"))
    feats = ["series_id", "horizon", "lag_0", "season", "mean_4"]
    a, b = (panels.supervised(p, [4]).where(F.col("t") == origin + 4).select(*feats) for p in (panel, changed))
    assert rows(a) == rows(b)


def test_conformal_order_statistics(spark):
    df = spark.createDataFrame([("a", float(i)) for i in range(1, 20)], "level string, score double")
    r = intervals.conformal_bounds(df, ["level"], "score", 0.8).first()
    assert (r.low, r.high, r.valid) == (2.0, 18.0, True)


def test_count_quantiles(spark):
    df = spark.createDataFrame([(1, 4.0, 1.0), (2, 4.0, 2.0)], "k int, mu double, phi double")
    got = {r.k: (r.lo, r.hi) for r in intervals.count_quantiles(df, "k", "mu", "phi", 0.8).collect()}
    assert got[1] == (2, 7) and got[2] == (1, 8)


def test_partial_autocorrelation(panel):
    a = evaluate.autocorrelation(panel.where("level = 'total'"), 5)
    acf, pacf = a.select("acf", evaluate.partial_autocorrelation(F.col("acf"), 5)).first()
    phi, out = [], []
    for k in range(1, 6):
        num = acf[k] - sum(p * acf[k - j] for j, p in enumerate(phi, 1))
        new = num / (1 - sum(p * acf[j] for j, p in enumerate(phi, 1)))
        phi = [p - new * q for p, q in zip(phi, reversed(phi))] + [new]
        out.append(new)
    assert all(abs(x - y) < 1e-9 for x, y in zip(out, pacf))


def test_tails(spark):
    t = spark.range(1).select(evaluate.normal_tail(F.lit(1.96)), evaluate.t_tail(F.lit(2.179), F.lit(12.0)), evaluate.t_tail(F.lit(0.0), F.lit(5.0))).first()
    assert abs(t[0] - 0.0249979) < 1e-6 and abs(t[1] - 0.025) < 1e-4 and abs(t[2] - 0.5) < 1e-6


def test_publish_checks_first(spark, tmp_path):
    df = spark.createDataFrame([(1, 2)], "k int, v int")
    with pytest.raises(ValueError, match="negative"):
        publish.publish(df.withColumn("v", F.lit(-1)), f"{tmp_path}/t", "one", {"negative": lambda d: d.where("v < 0")})
    assert publish.publish(df, f"{tmp_path}/t", "one", {"negative": lambda d: d.where("v < 0")}).count() == 1
    assert publish.refresh_period(df, f"{tmp_path}/p", "k", None) == [1]


def test_fingerprint_ignores_order(spark):
    df = spark.range(50).withColumn("v", F.col("id") * 3)
    assert readers.fingerprint(df).first() == readers.fingerprint(df.repartition(5).orderBy(F.desc("id"))).first()


def test_row_hashes_tell_fields_and_nulls_apart(spark):
    rows = spark.createDataFrame([("a|b", "c"), ("a", "b|c"), (None, "x"), ("-", "x"), ("\\N", "x"), ("1:a", ""), ("", "1:a")], "p string, q string")
    assert readers.provenance(rows, "s", ["p", "q"]).select("row_sha256").distinct().count() == rows.count()


def test_exact_signed_rank_p(spark):
    import itertools

    rows, want = [], []
    for n in (1, 2, 5, 9):
        sums = [sum(k for k, on in zip(range(1, n + 1), signs) if on) for signs in itertools.product((0, 1), repeat=n)]
        for w in range(n * (n + 1) // 4 + 1):
            rows.append((n, float(w)))
            want.append(min(1.0, 2 * sum(s <= w for s in sums) / len(sums)))
    # published critical values at 5 %, two-sided
    rows += [(n, float(w + d)) for n, w in ((6, 0), (10, 8), (15, 25), (20, 52), (25, 89)) for d in (0, 1)]
    got = [r[0] for r in spark.createDataFrame(rows, "n int, w double").coalesce(1).select(evaluate.signed_rank_p(F.col("n"), F.col("w"))).collect()]
    assert got[: len(want)] == pytest.approx(want)
    rest = got[len(want) :]
    assert all(p <= 0.05 for p in rest[::2]) and all(p > 0.05 for p in rest[1::2])
