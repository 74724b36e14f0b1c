"""What has to hold at any size: nearest places in dense and empty regions, ranks and quantiles of large groups, changes of tables."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyfold.operators import aggregates, evaluate, quadtree, ranks, selection
from tallyfold.sources import publish


def km(a, b):
    (x1, y1), (x2, y2) = a, b
    h = math.sin(math.radians(y2 - y1) / 2) ** 2 + math.cos(math.radians(y1)) * math.cos(math.radians(y2)) * math.sin(math.radians(x2 - x1) / 2) ** 2
    return 2 * quadtree.EARTH_KM * math.asin(math.sqrt(min(h, 1)))


def places(rng, n):
    """Clusters of all densities, both poles, the date line, and places that are far from all."""
    kinds = [
        lambda: (rng.gauss(-70.6, 0.02), rng.gauss(-33.4, 0.02)),
        lambda: (rng.gauss(-70.6, 1e-5), rng.gauss(-33.4, 1e-5)),
        lambda: (rng.uniform(-180, 180), rng.choice([-1, 1]) * rng.uniform(88, 90)),
        lambda: (rng.choice([-1, 1]) * rng.uniform(179, 181), rng.uniform(-20, 20)),
        lambda: (rng.uniform(-180, 180), math.degrees(math.asin(rng.uniform(-1, 1)))),
    ]
    return [rng.choice(kinds)() for _ in range(n)]


@pytest.mark.parametrize("bound", [2, 16])
def test_nearest_equals_all_pairs(spark, bound):
    rng = random.Random(bound)
    targets = places(rng, 500) + [(10.0, 10.0)] * 5
    points = places(rng, 200) + [(10.0, 10.0), (190.0, 10.0), (0.0, 90.0), (-180.0, -90.0), (180.0, 0.0)]
    df = lambda rows, name: spark.createDataFrame([(k, *xy) for k, xy in enumerate(rows)] + [(9999, None, 1.0), (9998, 1.0, None)], f"{name} int, lon double, lat double")
    got = {r.p: (r.t, r.km) for r in quadtree.nearest(df(points, "p"), df(targets, "t"), "p", "t", bound).collect()}
    assert len(got) == len(points)
    for k, xy in enumerate(points):
        want = min((km(xy, t), j) for j, t in enumerate(targets))
        assert got[k][1] == pytest.approx(want[0], abs=1e-9) and km(xy, targets[got[k][0]]) == pytest.approx(want[0], abs=1e-9), (k, xy)
    assert got[200][0] == 500
    assert quadtree.nearest(df(points, "p"), df([], "t").limit(0), "p", "t").count() == 0


def test_no_cell_is_over_its_bound(spark):
    rng = random.Random(4)
    rows = [(k, *xy) for k, xy in enumerate(places(rng, 3000))]
    own = spark.createDataFrame(rows, "t int, lon double, lat double").select("t", quadtree.wrapped(F.col("lon")).alias("lon"), "lat")
    cells = quadtree.tree(own, "t", 16)
    leaves = cells.where("not open").agg(F.max("n").alias("most"), F.sum("n").alias("all")).first()
    assert leaves.most <= 16 and leaves["all"] == 3000


def test_distance_to_a_box():
    rng = random.Random(9)
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    boxes = []
    for _ in range(60):
        w, s = rng.uniform(-180, 150), rng.uniform(-90, 80)
        boxes.append((rng.uniform(-180, 180), rng.uniform(-90, 90), w, w + rng.uniform(0, 30), s, s + rng.uniform(0, 10)))
    df = spark.createDataFrame(boxes, "lon double, lat double, w double, e double, s double, n double")
    got = [r[0] for r in df.select(quadtree.box_km(*(F.col(c) for c in ("lon", "lat", "w", "e", "s", "n")))).collect()]
    for (lon, lat, w, e, s, n), d in zip(boxes, got):
        grid = min(km((lon, lat), (x, y)) for x in np.linspace(w, e, 60) for y in np.linspace(s, n, 60))
        assert d <= grid + 1e-6 and grid - d < 60


def test_running_sums_and_ranks(spark):
    rng = random.Random(5)
    rows = [(k, rng.choice([1, 2, 2, 2, 50, None]), rng.random()) for k in range(5000)]
    df = spark.createDataFrame(rows, "k int, v int, x double")
    got = ranks.running(df, [F.desc_nulls_last("v"), F.col("k")], {"run": F.col("v"), "n": F.lit(1)}, rank="place").orderBy("place").collect()
    want = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    total = 0
    for at, (r, w) in enumerate(zip(got, want), 1):
        total += w[1] or 0
        assert (r.k, r.v, r.place, r.n, r.run) == (w[0], w[1], at, at, total)
    assert ranks.running(df.limit(0), [F.col("k")], {"run": F.col("v")}, rank="place").count() == 0
    plan = ranks.running(df, [F.col("k")], rank="place")._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" in plan and plan.count("windowspecdefinition(k") == 0


def test_quantiles_of_large_groups_equal_sorting(spark):
    rng = np.random.default_rng(6)
    values = np.concatenate([rng.pareto(0.5, 3000) * 1e3, np.full(2000, 7.0), -rng.random(1000)])
    rows = [("a", float(v)) for v in values] + [("b", float(v)) for v in range(9)] + [(None, 3.5)] * 400 + [("c", None), ("d", float("nan"))]
    df = spark.createDataFrame(rows, "k string, v double")
    qs = [0.0, 0.1, 1 / 3, 0.5, 0.99, 1.0]
    for small in (50, 10**6):
        got = {r.k: (r.n, r.quantiles) for r in selection.quantiles(df, ["k"], "v", qs, bins=8, small=small).collect()}
        assert set(got) == {"a", "b", None}
        for name, own in (("a", values), ("b", np.arange(9.0)), (None, np.full(400, 3.5))):
            assert got[name][0] == len(own) and np.allclose(got[name][1], np.quantile(own, qs), rtol=1e-12)
        stats = {r.k: r["values"] for r in selection.order_statistics(df, ["k"], "v", lambda n: [F.lit(0), n / 2, n, n + 5], small=small, bins=8).collect()}
        s = np.sort(values)
        assert stats["a"] == [s[0], s[2999], s[-1], s[-1]] and stats["b"] == [0.0, 3.0, 8.0, 8.0] and stats[None] == [3.5] * 4
    assert selection.quantiles(df, [], "v", [0.5], bins=16, small=100).first().quantiles[0] == pytest.approx(np.quantile([r[1] for r in rows if r[1] is not None and r[1] == r[1]], 0.5))
    assert selection.quantiles(df.limit(0), ["k"], "v", [0.5]).count() == 0


def test_no_change_is_missed(spark, tmp_path):
    make = lambda rows: spark.createDataFrame(rows, "p int, v int, w int")
    old = publish.period_prints(make([(1, 5, 0), (2, 7, 0)]), "p")
    target = f"{tmp_path}/t"
    make([(1, 5, 0), (2, 7, 0)]).write.partitionBy("p").parquet(target)
    assert publish.refresh_period(make([(1, 5, 0), (1, 9, 0), (1, 9, 0)]), target, "p", old) == [1]
    assert sorted((r.p, r.v) for r in spark.read.parquet(target).collect()) == [(1, 5), (1, 9), (1, 9), (2, 7)]
    assert publish.refresh_period(make([(1, 5, 0)]), target, "p", old) == []
    rng = random.Random(1)
    base = [(1, rng.randrange(3), rng.randrange(3)) for _ in range(12)]
    tables = [base, base[1:], base + base[:1], [*base[1:], (1, None, base[0][2])], [(p, w, v) for p, v, w in base], [(1, None, 4)], [(1, 4, None)], base * 2, base * 3]
    prints = [publish.period_prints(make(t), "p").drop("p").first() for t in tables]
    for i, a in enumerate(tables):
        for j, b in enumerate(tables):
            assert (prints[i] == prints[j]) == (sorted(map(str, a)) == sorted(map(str, b)))


def test_prints_of_batches_add_up(spark, tmp_path):
    rows = [(k % 3, k * k % 11) for k in range(40)]
    make = lambda part: spark.createDataFrame(part, "p int, v int")
    state = None
    for k in range(0, 40, 9):
        state = publish.append_periods(make(rows[k : k + 9]), f"{tmp_path}/t", "p", state)
    whole = publish.period_prints(make(rows), "p")
    assert publish.changed_periods(whole, state, "p").count() == 0
    assert publish.changed_periods(publish.period_prints(make(rows[1:] + [(9, 1)]), "p"), state, "p").count() == 2


def test_reading_what_is_published_writes_nothing(spark, tmp_path):
    root = f"file://{tmp_path}/r"
    assert publish.newest(spark, root).count() == 0 and not (tmp_path / "r").exists()
    publish.publish(spark.createDataFrame([(1,)], "k int"), root, "a", {})
    files = sorted(p.name for p in (tmp_path / "r/_published").iterdir())
    for _ in range(3):
        assert publish.published(spark, root, "a").count() == 1
    assert sorted(p.name for p in (tmp_path / "r/_published").iterdir()) == files


@pytest.mark.parametrize("bound", [0, 3, 10_000])
def test_profile_counts_distinct_values_by_sets_and_one_by_one(spark, bound):
    rows = [(k, None if k % 7 == 0 else f"v{k % 5}", ("", "*", "-2.5", None)[k % 4]) for k in range(400)]
    df = spark.createDataFrame(rows, "a long, b string, c string").repartition(5)
    got = {r.column: (r.nulls, r.blanks, r["distinct"], r.negatives) for r in aggregates.profile(df, ["a", "b", "c"], bound).collect()}
    assert got == {"a": (0, 0, 400, 0), "b": (58, 0, 5, 0), "c": (100, 200, 3, 100)}
    empty = aggregates.profile(df.limit(0), ["a", "b"], bound).collect()
    assert [tuple(r) for r in empty] == [("a", 0, 0, 0, 0), ("b", 0, 0, 0, 0)]


def test_harmonic_fits_of_zeros_short_and_seasonal_series(spark):
    rng = np.random.default_rng(3)
    rows = [("zero", "leaf", t, t % 52 + 1, 0) for t in range(60)] + [("short", "leaf", t, t + 1, 4 + t) for t in range(3)] + [("gap", "leaf", 0, 1, None)]
    rows += [("wave", "leaf", t, t % 52 + 1, int(rng.poisson(30 * math.exp(0.5 * math.sin(2 * math.pi * (t % 52 + 1) / 52))))) for t in range(208)]
    panel = spark.createDataFrame(rows, "series_id string, level string, t int, week int, y long")
    fits = evaluate.harmonic_fits(panel, 2)
    got = {(r.series_id, r.harmonics): r for r in fits.collect()}
    assert {k for k, _ in got} == {"zero", "short", "wave"}
    assert all(got["zero", k].deviance == 0 for k in range(3))
    assert got["short", 2].deviance == pytest.approx(0, abs=1e-6)
    y, w = (np.array([r[j] for r in rows if r[0] == "wave"], float) for j in (4, 3))
    assert got["wave", 1].fitted == pytest.approx([y.sum(), y @ np.sin(2 * np.pi * w / 52), y @ np.cos(2 * np.pi * w / 52)], abs=1e-6)
    assert got["wave", 0].deviance == pytest.approx(2 * float(np.where(y > 0, y * np.log(np.maximum(y, 1) / y.mean()), 0).sum()))
    tests = {(r.series_id, r.harmonics): r for r in evaluate.harmonic_test(fits).collect()}
    assert tests["wave", 1].p < 1e-6 < tests["wave", 2].p and tests["wave", 0].p is None and tests["zero", 1].p == 1
