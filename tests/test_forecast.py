"""Fitted models against fits by hand: the regressions of all origins at once, trees, the sparse model; publishing and refreshing."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyfold.operators import boosting, glm, intervals, models, panels
from tallyfold.sources import publish, shared
from tallyfold.streaming import refresh


@pytest.fixture(scope="module")
def panel(spark):
    rng = np.random.default_rng(5)
    rows = []
    for k, level in enumerate((40.0, 9.0, 25.0)):
        for t in range(170):
            rows.append((f"A{k}", "leaf", 1, t, 2000 + t // 52, t % 52 + 1, int(rng.poisson(level * (1 + 0.4 * np.sin(2 * np.pi * t / 52)))), 5 + k))
    leaves = spark.createDataFrame(rows, "series_id string, level string, service int, t int, year int, week int, y long, reporters long")
    total = leaves.groupBy("t", "year", "week").agg(F.sum("y").alias("y"), F.sum("reporters").alias("reporters"))
    return leaves.unionByName(total.select(F.lit("TOTAL").alias("series_id"), F.lit("total").alias("level"), F.lit(None).cast("int").alias("service"), "t", "year", "week", "y", "reporters")).cache()


def by_hand(x, y, ridge):
    """Newton steps on the penalised likelihood; the first column is the intercept."""
    beta = np.zeros(x.shape[1])
    beta[0] = np.log(y.mean())
    penalty = np.full(x.shape[1], ridge * len(y))
    penalty[0] = 0
    for _ in range(60):
        mu = np.exp(x @ beta)
        beta = beta + np.linalg.solve(x.T @ (x * mu[:, None]) + np.diag(penalty + 1e-12), x.T @ (y - mu) - penalty * beta)
    return beta


def test_regressions_of_all_origins_equal_fits_by_hand(panel):
    rows = panels.supervised(panel, [1, 3], covariates=("reporters",))
    names = panels.feature_names(covariates=("reporters",))
    made = glm.design(rows, names, 100)
    cells = [(150, 1, 150), (150, 3, 150), (160, 3, 160), (150, 1, 124)]
    fitted = glm.fit(made, cells)
    data, terms = made.select("series_id", "horizon", "t", "y", "x").toPandas(), fitted.terms.toPandas()
    series = sorted(set(data["series_id"]))
    for origin, horizon, until in cells:
        part = data[(data["horizon"] == horizon) & (data["t"] <= until)]
        x = np.column_stack([np.ones(len(part)), np.stack(part["x"]), *((part["series_id"] == s).to_numpy(float) for s in series)])
        own = terms[(terms["horizon"] == horizon) & (terms["until"] == until)].set_index("series_id")["term"]
        got = np.concatenate([fitted.beta[origin, horizon, until], own[series]])
        assert np.allclose(got, by_hand(x, part["y"].to_numpy(float), 1e-4), atol=1e-8)


def test_regression_of_many_series(spark):
    """The driver gets features squared numbers, not series squared: 20,000 series would need 3 GB a regression."""
    n = 20_000
    rows = spark.range(n * 6).select(F.format_string("s%05d", F.col("id") % n).alias("series_id"), F.lit(1).alias("horizon"), (F.col("id") / n).cast("int").alias("t"), F.array(F.sin("id"), F.cos(F.col("id") * 3)).alias("x"), (F.col("id") % n % 7).alias("k"))
    rows = rows.withColumn("y", F.round(5 * F.exp(F.col("x")[0] * 0.3 - F.col("x")[1] * 0.2 + F.col("k") / 5)).cast("long"))
    fitted = glm.fit(rows, [(5, 1, 5)], ridge=1e-8)
    beta = fitted.beta[5, 1, 5]
    assert len(beta) == 3 and abs(beta[1] - 0.3) < 0.01 and abs(beta[2] + 0.2) < 0.01
    assert fitted.terms.count() == n
    got = glm.predict(rows, fitted, [(5, 1, 5)], ["a", "b"], -5, 0).agg(F.sum("y").alias("y"), F.sum("mu").alias("mu")).first()
    assert abs(got.mu / got.y - 1) < 1e-4


def test_steps_are_halved_where_they_go_too_far(spark):
    rows = [("a", 1, t, [10.0 * (t % 5)], int(2 ** (3 * (t % 5)))) for t in range(40)] + [("b", 1, t, [0.0], 0) for t in range(40)]
    fitted = glm.fit(spark.createDataFrame(rows, "series_id string, horizon int, t int, x array<double>, y long"), [(39, 1, 39)], ridge=1e-6)
    assert abs(fitted.beta[39, 1, 39][1] - 3 * np.log(2) / 10) < 1e-3 and all(np.isfinite(r.term) for r in fitted.terms.collect())


def brute_tree(rows, until, settings, names, cuts):
    """The trees of one training set, from the definition."""
    use = rows[(rows["t"] <= until) & rows["y"].notna()]
    bins = np.stack([np.searchsorted(c, use[n], "left") for n, c in zip(names, cuts)], 1)
    score, y, code = use["base"].to_numpy(), use["y"].to_numpy(float), use["code"].to_numpy()
    for _ in range(settings.trees):
        mu = np.exp(score)
        groups = [np.arange(len(y))]
        for _ in range(settings.depth):
            split = []
            for g in groups:
                best, side = 1e-9, None
                G, H = (mu - y)[g].sum(), mu[g].sum()
                for f in range(len(names) + 1):
                    value = bins[g, f] if f < len(names) else code[g]
                    found = sorted(set(value))
                    if f == len(names):
                        found.sort(key=lambda v: ((mu - y)[g][value == v].sum() / (mu[g][value == v].sum() + boosting.RIDGE), v))
                    for k in range(1, len(found)):
                        left = np.isin(value, found[:k])
                        if left.sum() < boosting.LEAST_ROWS or (~left).sum() < boosting.LEAST_ROWS:
                            continue
                        gl, hl = (mu - y)[g][left].sum(), mu[g][left].sum()
                        gain = gl**2 / (hl + boosting.RIDGE) + (G - gl) ** 2 / (H - hl + boosting.RIDGE) - G**2 / (H + boosting.RIDGE)
                        if gain > best + 1e-7:
                            best, side = gain, left
                split += [g] if side is None else [g[side], g[~side]]
            groups = split
        for g in groups:
            score[g] -= settings.rate * (mu - y)[g].sum() / (mu[g].sum() + boosting.RIDGE)
    return use.assign(mu=np.exp(score))


def test_trees_of_all_origins_equal_trees_by_hand(spark):
    rng = np.random.default_rng(8)
    rows = [(f"s{k}", t, float(a := rng.normal()), float(rng.integers(0, 4)), int(rng.poisson(6 * np.exp(0.5 * (a > 0.3) + 0.4 * (k % 3)))), 6.0) for k in range(7) for t in range(60)]
    df = spark.createDataFrame(rows, "series_id string, t int, a double, b double, y long, level0 double")
    made, series, cuts = boosting.binned(df, ["a", "b"], 40, "level0")
    settings = boosting.Settings(trees=5, depth=2, rate=0.5, keep=2)
    grown = boosting.Ensembles([40, 55], settings).fit(made, len(series))
    data = made.toPandas()
    for until in (40, 55):
        want = brute_tree(data, until, settings, ["a", "b"], cuts)
        got = grown.predict(made.where(F.col("t") <= until).withColumn("until", F.lit(until))).select("series_id", "t", "mu").toPandas()
        both = want.merge(got, on=["series_id", "t"])
        assert len(both) == len(want) and np.allclose(both["mu_x"], both["mu_y"])
    assert {f for _, f, *_ in grown.roots(["a", "b"], cuts)} <= {"a", "b", "series"}


def test_backtest_and_forecast_with_fitted_models(panel):
    back = models.backtest(panel, ["naive", "poisson", "trees"], [1, 4], n=2, step=4).toPandas()
    assert set(back["model"]) == {"naive", "poisson", "trees"} and len(back) == 3 * 2 * 2 * 4
    assert (back["lo"] <= back["hi"]).all() and (back["lo"] >= 0).all()
    error = back.assign(e=(back["y_real"] - back["y_pred"]).abs()).groupby("model")["e"].mean()
    assert error["poisson"] < 1.2 * error["naive"] and error["trees"] < 1.5 * error["naive"]
    covered = back[back["model"] == "poisson"].eval("lo <= y_real <= hi").mean()
    assert covered > 0.6
    ahead = models.forecast(panel, "poisson", 3).toPandas()
    assert sorted(set(ahead["t"])) == [170, 171, 172] and len(ahead) == 12 and ahead["y_real"].isna().all()


def test_fitted_models_learn_from_rows_written_once(panel, monkeypatch):
    names, kept = [], shared.kept
    monkeypatch.setattr(shared, "kept", lambda df, name: names.append(name) or kept(df, name))
    back = models.backtest(panel, ["naive", "poisson", "trees"], [1], n=1)
    assert names.count("supervised") == 1 and {r[0] for r in back.select("model").collect()} == {"naive", "poisson", "trees"}
    names.clear()
    models.backtest(panel, ["naive"], [1], n=1)
    assert "supervised" not in names


def test_sparse_hierarchy(spark, panel):
    rows = panel.withColumn("days", F.lit(7)).drop("reporters", "service")
    people = spark.createDataFrame([("A0", 400), ("A1", 100), ("A2", 250)], "series_id string, people long")
    got = models.sparse_hierarchy(rows, people, 160, [1, 2, 9]).toPandas()
    assert len(got) == 12 and (got["lo"] <= got["hi"]).all() and (got["covered"] >= 0.8 - 1e-6).all()
    leaves = got[got["level"] == "leaf"]
    share = leaves.groupby("series_id")["share"].first()
    assert abs(share.sum() - 1) < 1e-9 and share["A0"] > share["A2"] > share["A1"]
    total = got[got["level"] == "total"].set_index("t")["y_pred"]
    assert np.allclose(leaves.groupby("t")["y_pred"].sum(), total.sort_index())


def test_quantiles_of_large_counts(spark):
    df = spark.createDataFrame([("a", 0.4, 1.0), ("b", 30_000.0, 1.0), ("c", 30_000.0, 3.0), ("d", 0.0, 2.0), ("e", 1e8, 1.0), ("f", None, 1.0)], "k string, mu double, phi double")
    got = {r.k: r for r in intervals.count_quantiles(df, "k", "mu", "phi", 0.8).collect()}
    assert (got["a"].lo, got["a"].hi) == (0, 1) and (got["d"].lo, got["d"].hi) == (0, 0) and got["f"].lo is None
    for k, phi in (("b", 1), ("c", 3)):
        assert abs(got[k].hi - (30_000 + 1.2816 * np.sqrt(30_000 * phi))) < 3 and 0.8 <= got[k].covered < 0.81
    assert abs(got["e"].hi - (1e8 + 1.2815516 * 1e4)) < 2
    plan = intervals.count_quantiles(df, "k", "mu", "phi", 0.8)._jdf.queryExecution().toString()
    assert "Generate" not in plan and "Exchange" not in plan


@pytest.mark.parametrize("phi", [1.0, 1.3, 2.5, 30.0])
def test_count_quantiles_equal_sums_of_probabilities(phi):
    rng = np.random.default_rng(2)
    for m in [0.01, 0.3, *np.exp(rng.uniform(0, 8, 12))]:
        k = np.arange(int(m + 14 * np.sqrt(phi * m) + 40 * phi) + 2, dtype=float)
        if phi == 1:
            steps = np.log(m / np.maximum(k, 1))
            first = -m
        else:
            size = m / (phi - 1)
            steps, first = np.log((size + k - 1) / np.maximum(k, 1) * (1 - 1 / phi), where=k > 0, out=np.zeros(len(k))), size * np.log(1 / phi)
        steps[0] = first
        cdf = np.cumsum(np.exp(np.cumsum(steps)))
        assert np.allclose(intervals.count_cdf(k, np.full(len(k), m), np.full(len(k), phi)), cdf, atol=1e-9)
        for share in (0.1, 0.5, 0.975):
            assert intervals._least(share, np.array([m]), np.array([phi]))[0] == np.searchsorted(cdf, share)


def test_tables_are_published_together_or_not_at_all(spark, tmp_path):
    one, two = (spark.createDataFrame([(1, v)], "k int, v int") for v in (1, 2))
    positive = {"positive": lambda d: d.where("v < 0")}
    root = f"file://{tmp_path}/marts"
    publish.publish_together(root, {"a": (one, positive), "b": (one, positive)})
    with pytest.raises(ValueError, match="b: checks failed"):
        publish.publish_together(root, {"a": (two, positive), "b": (two.withColumn("v", F.lit(-1)), positive)})
    assert publish.published(spark, root, "a").first().v == 1
    put = publish.publish_together(root, {"a": (two, positive), "b": (two, {})}, {"b": ["k"]})
    assert put["a"].first().v == put["b"].first().v == 2 and publish.newest(spark, root).where("version = 2").count() == 2
    with pytest.raises(ValueError, match="never"):
        publish.published(spark, root, "c")


def test_refresh_keeps_equal_rows_and_repeats_a_batch_without_harm(spark, tmp_path):
    source, target, state = (f"{tmp_path}/{x}" for x in ("in", "out", "state"))
    schema = "day int, v int"
    for rows in ([(1, 5), (1, 5), (2, 7)], [(1, 5), (3, 1)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        refresh.by_period(spark, source, target, state, schema, "day")
    assert sorted(map(tuple, refresh.current(spark, target, schema).select("day", "v").collect())) == [(1, 5), (1, 5), (1, 5), (2, 7), (3, 1)]


def test_weekly_counts_of_a_stream(spark, tmp_path):
    days = [("2026-01-04", 1), ("2026-01-10", 1), ("2026-01-11", 1), ("2026-02-20", 2)]
    spark.createDataFrame(days, "d string, k int").select(F.to_timestamp("d").alias("ts"), "k").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("ts timestamp, k int").parquet(f"{tmp_path}/in")
    q = refresh.weekly_counts(stream, "ts", ["k"]).writeStream.format("memory").queryName("weekly").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(str(r.week_start.date()), r.k): r.n for r in spark.table("weekly").collect()}
    assert got == {("2026-01-04", 1): 2, ("2026-01-11", 1): 1}
