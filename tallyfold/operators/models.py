"""Forecast models over panels (series_id, level, service, t, year, week, y), and their backtests.

Naive models need no fit: all origins and horizons are one job. The Poisson regressions of all origins and horizons
are fitted together, a job a round, and so are the boosted trees, a job a level. Other columns of a panel are covariates, of which fitted models use what is known at the origin.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyfold.functions import calendar
from tallyfold.operators import boosting, glm, intervals, panels, selection
from tallyfold.sources import shared

SEASON, LEVEL = 52, 0.8
KEYS = ["model", "origin", "horizon"]
COLUMNS = [*KEYS, "series_id", "level", "service", "t", "y_real", "y_pred", "lo", "hi"]


def future_only(forecast: DataFrame, panel: DataFrame) -> DataFrame:
    """Steps after the panel's last observed period."""
    last = panel.where("y is not null").agg(F.max("t").alias("__last"))
    return forecast.crossJoin(F.broadcast(last)).where(F.col("t") > F.col("__last")).drop("__last")


def origins(panel: DataFrame, longest: int, n: int, step: int) -> DataFrame:
    """(origin): n origins, ``step`` apart, the last of which still has all its targets in the panel."""
    last = panel.agg(F.max("t").alias("m"))
    return last.select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.col("m") - longest - i * step)).alias("origin")).where("origin >= 0")


def season_residuals(panel: DataFrame) -> DataFrame:
    """(series_id, level, t, r): error of repeating the period a season ago."""
    return panel.withColumn("r", F.col("y") - panels.lag(SEASON)).where("r is not null").select("series_id", "level", "t", "r")


def interval_of_residuals(residuals: DataFrame, at: DataFrame, level: float = LEVEL, least: int = 20) -> DataFrame:
    """(series_id, origin, low, high): residual quantiles of the history up to each origin.

    A series with under ``least`` residuals gets those of all series together.
    """
    q = F.array(F.lit((1 - level) / 2), F.lit((1 + level) / 2))
    known = residuals.crossJoin(F.broadcast(at)).where(F.col("t") <= F.col("origin"))
    own = known.groupBy("series_id", "origin").agg(F.percentile("r", q).alias("q"), F.count("*").alias("n"))
    pooled = selection.quantiles(known, ["origin"], "r", [(1 - level) / 2, (1 + level) / 2]).select("origin", F.col("quantiles").alias("p"))
    best = F.when(F.col("n") >= least, F.col("q")).otherwise(F.col("p"))
    # a row per origin
    return own.join(F.broadcast(pooled), "origin").select("series_id", "origin", best[0].alias("low"), best[1].alias("high"))


def _targets(panel: DataFrame, at: DataFrame, horizons: list[int]) -> DataFrame:
    steps = at.select("origin", F.explode(F.array(*map(F.lit, horizons))).alias("horizon")).withColumn("t", F.col("origin") + F.col("horizon"))
    # origins and horizons are a few dozen rows
    return panel.join(F.broadcast(steps), "t").withColumnRenamed("y", "y_real")


def _finish(rows: DataFrame, model: str, point: Column) -> DataFrame:
    rows = rows.withColumn("y_pred", F.greatest(point.cast("double"), F.lit(0.0)))
    lo = F.greatest(F.col("y_pred") + F.col("low"), F.lit(0.0))
    return rows.select(F.lit(model).alias("model"), *COLUMNS[1:9], lo.alias("lo"), F.greatest(F.col("y_pred") + F.col("high"), lo).alias("hi"))


def naive(panel: DataFrame, at: DataFrame, horizons: list[int]) -> DataFrame:
    """The period a season ago, with the quantiles of its past errors."""
    season = panel.select("series_id", (F.col("t") + SEASON).alias("t"), F.col("y").alias("season"))
    rows = _targets(panel, at, horizons).join(season.hint("merge"), ["series_id", "t"])
    return _finish(rows.join(interval_of_residuals(season_residuals(panel), at).hint("merge"), ["series_id", "origin"]), "naive", F.col("season"))


def drift(panel: DataFrame, at: DataFrame, horizons: list[int], width: int = 13) -> DataFrame:
    """The period a season ago plus the mean change of the last ``width`` periods, not below 0."""
    residuals = season_residuals(panel)
    change = residuals.crossJoin(F.broadcast(at)).where((F.col("t") <= F.col("origin")) & (F.col("t") > F.col("origin") - width)).groupBy("series_id", "origin").agg(F.avg("r").alias("change"))
    season = panel.select("series_id", (F.col("t") + SEASON).alias("t"), F.col("y").alias("season"))
    rows = _targets(panel, at, horizons).join(season.hint("merge"), ["series_id", "t"]).join(change.hint("merge"), ["series_id", "origin"])
    return _finish(rows.join(interval_of_residuals(residuals, at).hint("merge"), ["series_id", "origin"]), "drift", F.col("season") + F.col("change"))


def zero(panel: DataFrame, at: DataFrame, horizons: list[int]) -> DataFrame:
    """Always 0: the reference for sparse counts."""
    return _finish(_targets(panel, at, horizons).withColumns({"low": F.lit(0.0), "high": F.lit(0.0)}), "zero", F.lit(0.0))


def backtest(panel: DataFrame, models: list[str], horizons: list[int], n: int = 13, step: int = 4) -> DataFrame:
    """Predictions of the named models from every origin, one row per (model, origin, horizon, series)."""
    at = origins(panel, max(horizons), n, step)
    # fitted models learn from the same rows, written once
    known = {"rows": _supervised(panel, horizons)} if set(models) & FITTED else {}
    out = None
    for name in models:
        rows = REGISTRY[name](panel, at, horizons, **(known if name in FITTED else {}))
        out = rows if out is None else out.unionByName(rows)
    return out


def forecast(panel: DataFrame, model: str, steps: int) -> DataFrame:
    """Predictions of the periods after the panel's end."""
    marked = panel.unionByName(panels.future_rows(panel, steps).drop("horizon"), allowMissingColumns=True)
    at = panel.where("y is not null").agg(F.max("t").alias("origin"))
    return REGISTRY[model](marked, at, list(range(1, steps + 1)))


def level_hybrid(predictions: DataFrame, total: str, leaves: str, name: str = "hybrid") -> DataFrame:
    """The total from one model, all below from another; to be reconciled."""
    keep = F.when(F.col("level") == "total", F.col("model") == total).otherwise(F.col("model") == leaves)
    return predictions.where(keep).withColumn("model", F.lit(name))


class Estimator(Protocol):
    """What a fitted model offers: predictions for target rows after a fit on training rows."""

    def fit_predict(self, train: DataFrame, target: DataFrame) -> DataFrame: ...


class ByPandas:
    """A model of the user: a function from a series' rows (train and target, with y missing in the target)."""

    def __init__(self, function: Callable, schema: str):
        self.function, self.schema = function, schema

    def fit_predict(self, train: DataFrame, target: DataFrame) -> DataFrame:
        both = train.unionByName(target.withColumn("y", F.lit(None).cast("long")), allowMissingColumns=True)
        return both.groupBy("series_id").applyInPandas(self.function, self.schema)


def seasonal_poisson(total: DataFrame, origin: int, half_life: float = 104.0, harmonics: int = 2) -> DataFrame:
    """``total`` with ``mu``: one series by harmonics, with days of exposure as offset and weights that halve with age."""
    terms = calendar.fourier(F.col("week"), harmonics)
    rows = total.withColumns({**terms, "offset": F.log(F.coalesce(F.col("days"), F.lit(7)) / 7.0), "weight": age_weight(origin, half_life)})
    stages = [VectorAssembler(inputCols=list(terms), outputCol="features"), GeneralizedLinearRegression(family="poisson", link="log", labelCol="y", offsetCol="offset", weightCol="weight", predictionCol="mu")]
    # rows to be predicted may have no count yet
    return Pipeline(stages=stages).fit(rows.where((F.col("t") <= origin) & F.col("y").isNotNull())).transform(rows.withColumn("y", F.col("y").cast("double"))).select(*total.columns, "mu")


def seasonal_scores(total: DataFrame, origin: int, half_life: float = 104.0, harmonics: int = 2) -> DataFrame:
    """(term, fitted): weighted sums of each term times the fitted mean, which at the maximum are those times the count."""
    fitted = seasonal_poisson(total, origin, half_life, harmonics).where((F.col("t") <= origin) & F.col("y").isNotNull())
    terms = {"one": F.lit(1.0), **calendar.fourier(F.col("week"), harmonics)}
    sums = fitted.agg(*(F.sum(age_weight(origin, half_life) * x * F.col("mu")).alias(n) for n, x in terms.items()))
    return sums.unpivot([], list(terms), "term", "fitted")


def age_weight(origin: int, half_life: float) -> Column:
    return F.pow(F.lit(0.5), (F.lit(origin) - F.col("t")) / half_life)


def sparse_hierarchy(rows: DataFrame, people: DataFrame, origin: int, horizons: list[int], half_life: float = 104.0, harmonics: int = 2, coverage: float = LEVEL) -> DataFrame:
    """(origin, horizon, series_id, level, t, y_real, y_pred, share, lo, hi, covered) for sparse counts.

    ``rows`` has the total and the leaves, with ``days`` of each period. The total is ``seasonal_poisson``; a leaf has
    a share of it, proportional to its people times its relative rate, which is drawn towards 1 by a gamma prior. The
    dispersion of each level, 1 at least, is that of its weighted training rows; bounds are quantiles of counts.
    """
    mu = shared.kept(seasonal_poisson(rows.where("level = 'total'"), origin, half_life, harmonics).select("t", F.col("mu").alias("whole")), "total-mu")
    weight = age_weight(origin, half_life)
    every = W.partitionBy()
    counts = rows.where("level = 'leaf'").where(F.col("t") <= origin).groupBy("series_id").agg(F.sum(F.col("y") * weight).alias("n")).join(people, "series_id")
    counts = counts.withColumn("pi", F.col("people") / F.sum("people").over(every)).withColumn("expected", F.sum("n").over(every) * F.col("pi"))
    counts = shared.kept(counts, "leaf-counts")
    shape = F.exp(F.lit(float(gamma_shape(counts).first()["log_shape"])))
    drawn = F.col("pi") * shrunk_shares(shape)
    shares = counts.select("series_id", drawn.alias("drawn")).select("series_id", (F.col("drawn") / F.sum("drawn").over(every)).alias("share"))
    # one row per leaf, and per period
    full = rows.join(shares.hint("shuffle_hash"), "series_id", "left").withColumn("share", F.when(F.col("level") == "total", 1.0).otherwise(F.col("share")))
    full = full.join(mu.hint("shuffle_hash"), "t").withColumn("mu", F.col("whole") * F.col("share"))
    past = full.where((F.col("t") <= origin) & (F.col("mu") > 0))
    spread = F.sum(weight * F.pow(F.col("y") - F.col("mu"), 2) / F.col("mu"))
    terms = F.when(F.col("level") == "total", F.lit(2 * harmonics + 1)).otherwise(F.count_distinct("series_id"))
    phi = past.groupBy("level").agg((spread / F.greatest(F.sum(weight) - terms, F.lit(1.0))).alias("phi")).select("level", F.greatest("phi", F.lit(1.0)).alias("phi"))
    # two rows
    ahead = full.where((F.col("t") - origin).isin(horizons)).join(F.broadcast(phi), "level")
    out = ahead.withColumn("range", intervals.count_interval(F.col("mu"), F.col("phi"), coverage))
    return out.select(F.lit(origin).alias("origin"), (F.col("t") - origin).alias("horizon"), "series_id", "level", "t", F.col("y").alias("y_real"), F.col("mu").alias("y_pred"), "share", "range.lo", "range.hi", "range.covered")


def gamma_shape(counts: DataFrame, n: str = "n", expected: str = "expected") -> DataFrame:
    """(log_shape, log_likelihood): the shape of relative rates by marginal likelihood, on a grid refined twice."""
    low, high, size = -3.0, 12.0, 60
    best = None
    for _ in range(3):
        step = (high - low) / size
        grid = F.transform(F.sequence(F.lit(0), F.lit(size)), lambda i: F.lit(low) + i * F.lit(step))
        tried = counts.select(F.col(n).cast("double").alias("n"), F.greatest(F.col(expected), F.lit(1e-9)).alias("e"), F.explode(grid).alias("log_shape"))
        a, k, e = F.exp("log_shape"), F.col("n"), F.col("e")
        terms = intervals.log_gamma(k + a) - intervals.log_gamma(a) + a * F.log(a / (a + e)) + k * F.log(e / (a + e))
        best = tried.groupBy("log_shape").agg(F.sum(terms).alias("log_likelihood")).orderBy(F.desc("log_likelihood"), "log_shape").limit(1)
        centre = best.first()["log_shape"]
        low, high = max(-3.0, centre - step), min(12.0, centre + step)
    return best


def shrunk_shares(shape: Column, n: str = "n", expected: str = "expected") -> Column:
    """Relative rate of a leaf, drawn towards 1: (n + a) / (e + a)."""
    return (F.col(n) + shape) / (F.col(expected) + shape)


def _supervised(panel: DataFrame, horizons: list[int]) -> DataFrame:
    """Rows of all horizons, written, as every round of a fit reads them."""
    covariates = tuple(c for c in panel.columns if c not in ("series_id", "level", "service", "t", "year", "week", "y", "horizon"))
    return shared.kept(panels.supervised(panel, horizons, covariates=covariates), "supervised")


def _origins(at: DataFrame) -> list[int]:
    """The origins of a backtest: a dozen or so."""
    return sorted(r[0] for r in at.select("origin").collect())


def _features(panel: DataFrame, rows: DataFrame) -> list[str]:
    return [c for c in rows.columns if c not in ("series_id", "level", "service", "t", "year", "week", "y", "horizon") and c not in panel.columns]


def poisson_scores(panel: DataFrame, origins: list[int], horizons: list[int]) -> DataFrame:
    """The sums that the score equations of the Poisson regressions tie to the data (``glm.score_sums``)."""
    rows = _supervised(panel, horizons)
    return glm.score_sums(rows, _features(panel, rows), origins, horizons)


def poisson(panel: DataFrame, at: DataFrame, horizons: list[int], rows: DataFrame | None = None) -> DataFrame:
    """A global Poisson regression for each origin and horizon, with quantiles of counts as bounds.

    ``rows`` are the supervised rows of the panel, if they are written already.
    """
    rows = _supervised(panel, horizons) if rows is None else rows
    names = _features(panel, rows)
    return glm.forecasts(rows, names, _origins(at), horizons).select(F.lit("poisson").alias("model"), *COLUMNS[1:])


def relative_features(rows: DataFrame, names: list[str], base: str = "mean_13") -> DataFrame:
    """``rows`` with the features that are counts divided by the mean of the last known periods, so that series of any size are alike."""
    own = [n for n in names if n != base and n.startswith(("lag_", "season", "year_change", "mean_", "sd_"))]
    return rows.withColumns({n: F.col(n) / (F.col(base) + 0.5) for n in own})


def _binned(panel: DataFrame, rows: DataFrame, until: int) -> tuple[list[str], DataFrame, list[str], list[list[float]]]:
    names = [c for c in rows.columns if c not in ("series_id", "level", "service", "t", "year", "week", "y", "horizon") and c not in panel.columns] + ["horizon"]
    return names, *boosting.binned(relative_features(rows, names), names, until, "mean_13")


def first_splits(panel: DataFrame, at: DataFrame, horizons: list[int], calibration: int = 26) -> DataFrame:
    """(origin, feature, cut, left, right): the root of the first tree of each origin, and the Newton step on its two sides."""
    ends = _origins(at)
    names, made, series, cuts = _binned(panel, _supervised(panel, horizons), min(ends) - calibration)
    roots = boosting.Ensembles(ends, boosting.Settings(trees=1, depth=1, rate=1.0)).fit(made, len(series)).roots(names, cuts)
    # a row per origin
    return panel.sparkSession.createDataFrame(roots, "origin int, feature string, cut double, left double, right double")


def trees(panel: DataFrame, at: DataFrame, horizons: list[int], calibration: int = 26, least: int = 20, coverage: float = LEVEL, settings: boosting.Settings | None = None, rows: DataFrame | None = None) -> DataFrame:
    """Boosted trees for each origin, all horizons in one ensemble; bounds are quantiles of relative errors.

    The ensembles of all origins grow together. The errors are those of ensembles that have not seen the last
    ``calibration`` periods before their origin; a series with under ``least`` of them gets the quantiles of all.
    ``rows`` are the supervised rows of the panel, if they are written already.
    """
    ends = _origins(at)
    names, made, series, _ = _binned(panel, _supervised(panel, horizons) if rows is None else rows, min(ends) - calibration)
    grown = boosting.Ensembles([u for o in ends for u in (o, o - calibration)], settings).fit(made, len(series))
    # a row per origin
    table = F.broadcast(panel.sparkSession.createDataFrame([(o,) for o in ends], "origin int"))
    past = made.where("y is not null").join(table, F.expr(f"t > origin - {calibration} and t <= origin")).withColumn("until", F.col("origin") - calibration)
    errors = shared.kept(grown.predict(past).where("mu > 0").select("origin", "series_id", (F.col("y") / F.col("mu") - 1).alias("r")), "errors")
    ahead = grown.predict(made.join(table, F.expr("t = origin + horizon")).withColumn("until", F.col("origin")))
    q = [(1 - coverage) / 2, (1 + coverage) / 2]
    own = errors.groupBy("origin", "series_id").agg(F.percentile("r", F.array(*map(F.lit, q))).alias("q"), F.count("*").alias("n"))
    pooled = selection.quantiles(errors, ["origin"], "r", q).select("origin", F.col("quantiles").alias("p"))
    got = ahead.join(own.hint("shuffle_hash"), ["origin", "series_id"], "left").join(F.broadcast(pooled), "origin")
    best = F.when(F.col("n") >= least, F.col("q")).otherwise(F.col("p"))
    lo = F.greatest(F.col("mu") * (1 + best[0]), F.lit(0.0))
    got = got.select(F.lit("trees").alias("model"), "origin", "horizon", "series_id", "level", "service", "t", F.col("y").alias("y_real"), F.col("mu").alias("y_pred"), lo.alias("lo"), F.greatest(F.col("mu") * (1 + best[1]), lo).alias("hi"))
    # the model lives on the driver and its plan carries it: its predictions are written
    return shared.kept(got, "trees")


REGISTRY: dict[str, Callable[..., DataFrame]] = {"naive": naive, "drift": drift, "zero": zero, "poisson": poisson, "trees": trees}
#: Models that learn from supervised rows.
FITTED = {"poisson", "trees"}
