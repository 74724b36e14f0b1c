"""Queries on tables that are larger, or of other shapes, than the test tables: constants of small data must not show."""

import contextlib
import datetime
import io
import math
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from tallyfold.operators import glm
from tallyfold.plans import q_forecast, registry, testbed
from tallyfold.sources import shared


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Facts on both sides of years of 52 and 53 weeks, repeated, without day, facility or known facility; areas and facilities without facts."""
    folder, rng = str(tmp_path_factory.mktemp("odd")), random.Random(4)
    ends = [datetime.datetime(y, m, d) for y in range(2022, 2027) for m, d in [(1, k) for k in range(1, 11)] + [(12, k) for k in range(22, 32)]]
    other = [datetime.datetime(2022, 3, 1) + datetime.timedelta(days=rng.randrange(1700)) for _ in range(300)]
    rows = [(k, rng.choice([1, 2, 3, 4, 5, 77, None]), float(rng.randrange(1, 50)), "A", "F", day) for k, day in enumerate(3 * ends + other)]
    rows += rows[:200] + [(9, 1, 4.0, "A", "F", None)] * 3
    spark.createDataFrame(rows, "l_orderkey long, l_suppkey long, l_quantity double, l_returnflag string, l_linestatus string, l_shipdate timestamp").repartition(5).write.parquet(f"{folder}/lineitem.parquet")
    spark.createDataFrame([(1, 0), (2, 0), (3, 1), (4, 2), (5, 9), (6, 1)], "s_suppkey long, s_nationkey int").write.parquet(f"{folder}/supplier.parquet")
    spark.createDataFrame([(0, 0), (1, 0), (2, 1), (3, 1)], "n_nationkey int, n_regionkey int").write.parquet(f"{folder}/nation.parquet")
    return folder


def test_reporters_and_sums_of_odd_facts_equal_their_sql(spark, odd):
    duck = duckdb.connect()
    for name in ("lineitem", "supplier", "nation"):
        duck.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{odd}/{name}.parquet/*.parquet')")
    columns = "series_id, level, service, t, year, week, y, reporters"
    want = duck.execute(f"WITH {testbed.PANEL}, {q_forecast._REPORTERS} SELECT {columns} FROM covered").fetchall()
    got = [tuple(r) for r in q_forecast.with_reporters(testbed.Tables(spark, odd)).select(*columns.split(", ")).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    # repeated facts of a facility count once
    assert max(r[7] for r in got if r[0] == "A00") == 2 and max(r[7] for r in got if r[0] == "TOTAL") == 4


def test_facts_are_read_once_a_table_and_shrink_to_facilities_and_years(spark, odd, monkeypatch):
    plans, kept = {}, shared.kept

    def noted(df, name):
        out = io.StringIO()
        with contextlib.redirect_stdout(out):
            df.explain()
        plans[name] = out.getvalue()
        return kept(df, name)

    monkeypatch.setattr(shared, "kept", noted)
    q_forecast.with_reporters(testbed.Tables(spark, odd))
    reads = {name: len(re.findall(r"FileScan parquet \[[^]]*l_shipdate", plan)) for name, plan in plans.items()}
    # the calendar, the sums, the reporters
    assert max(reads.values()) == 1 and sum(reads.values()) == 3
    shuffled = [keys for plan in plans.values() for keys in re.findall(r"hashpartitioning\(([^)]*)\)", plan) if "facility" in keys]
    assert shuffled and not any("week" in keys for keys in shuffled)


def test_reporters_of_many_years_shrink_to_facilities(spark, tmp_path):
    """Facts of 1990 to 2026, in every year, in five runs of eight years: what is shuffled by facility is a row for each of those, not for each year."""
    folder, rng = str(tmp_path), random.Random(5)
    days = [datetime.datetime(y, 1, 1) + datetime.timedelta(days=d) for y in range(1990, 2027) for d in [0, 1, 2, 362, 363, 364, *(rng.randrange(365) for _ in range(6))]]
    rows = [(k, f, 1.0, "A", "F", day) for f in (1, 2, 3) for k, day in enumerate(days) if f != 2 or day.year in (1997, 1998, 2013)] + [(9, 1, 4.0, "A", "F", None)]
    spark.createDataFrame(rows, "l_orderkey long, l_suppkey long, l_quantity double, l_returnflag string, l_linestatus string, l_shipdate timestamp").repartition(3).write.parquet(f"{folder}/lineitem.parquet")
    spark.createDataFrame([(1, 0), (2, 0), (3, 1)], "s_suppkey long, s_nationkey int").write.parquet(f"{folder}/supplier.parquet")
    spark.createDataFrame([(0, 0), (1, 0)], "n_nationkey int, n_regionkey int").write.parquet(f"{folder}/nation.parquet")
    duck = duckdb.connect()
    for name in ("lineitem", "supplier", "nation"):
        duck.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet/*.parquet')")
    want = duck.execute(f"WITH {testbed.WEEKLY} SELECT area, region, year, week, count(DISTINCT facility) FROM weekly WHERE day IS NOT NULL GROUP BY ALL").fetchall()
    made = testbed.area_reporters(testbed.Tables(spark, folder))
    assert sorted(map(tuple, made.collect())) == sorted(want) and max(r[4] for r in want) == 2
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        made.explain()
    keys = {re.sub(r"#\d+L?", "", k) for k in re.findall(r"hashpartitioning\(([^)]*)\)", out.getvalue()) if "facility" in k}
    assert keys and not any("year" in k or "week" in k for k in keys)


def test_quantiles_of_counts_equal_their_sql_at_means_over_the_small_tables(spark, tmp_path):
    """Areas 0 and 1 have 500 and 1,000 orders in a period, with and without excess variance; area 2 has a few in all."""
    folder = str(tmp_path)
    spark.createDataFrame([(k, k) for k in range(3)], "c_custkey long, c_nationkey int").write.parquet(f"{folder}/customer.parquet")
    key = F.when(F.col("id") < 42_000, 0).when(F.col("id") < 126_000, 1).otherwise(2)
    spark.range(126_005).select(F.col("id").alias("o_orderkey"), key.cast("long").alias("o_custkey")).write.parquet(f"{folder}/orders.parquet")
    duck = duckdb.connect()
    for name in ("customer", "orders"):
        duck.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet/*.parquet')")
    want = sorted(duck.execute(registry.SQL["l9_count_quantiles"]).fetchall())
    got = sorted(tuple(r[c] for c in ("area", "lo", "hi", "covered")) for r in registry.QUERIES["l9_count_quantiles"](spark, folder).collect())
    assert [r[0] for r in got] == [0, 1, 2] and got[0][1] < 500 < got[0][2] and got[1][1] < 1000 < got[1][2]
    assert got == want


def test_rounds_of_regressions_do_not_grow_with_counts(spark, monkeypatch):
    """``mean`` repeats the features before it, so that the counts say nothing of one direction of the coefficients."""
    rng = random.Random(9)
    names, made, real = ["a", "b", "c", "mean", "d"], [], glm._Regressions
    monkeypatch.setattr(glm, "_Regressions", lambda *a: made.append(1) or real(*a))
    shapes = [(f"s{k}", 1, t, *(rng.gauss(0, 1) for _ in range(4)), rng.random()) for k in range(3) for t in range(60)]
    for times in (10, 10**9):
        rows = [(s, h, t, a, b, c, (a + b + c) / 3, d, int(times * math.exp(0.2 * a - 0.1 * b + 0.3 * d) * (1 + e))) for s, h, t, a, b, c, d, e in shapes]
        made.clear()
        got = glm.score_sums(spark.createDataFrame(rows, "series_id string, horizon int, t int, a double, b double, c double, mean double, d double, y long"), names, [40, 59], [1]).collect()
        # one more makes the terms of the series
        assert len(made) - 1 <= 10
        for o in (40, 59):
            used = [r for r in rows if r[2] <= o]
            want = {n: sum(r[3 + k] * r[-1] for r in used) for k, n in enumerate(names)} | {s: sum(r[-1] for r in used if r[0] == s) for s in ("s0", "s1", "s2")}
            size = sum(r[-1] for r in used)
            assert {r["term"]: r["fitted"] for r in got if r["origin"] == o} == pytest.approx(want, abs=1e-9 * size)
