"""Measures of forecasts, paired tests, selection, and diagnostics of series."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyfold.functions import calendar
from tallyfold.operators import panels

SEASON = 52


def point_errors() -> list[Column]:
    """Aggregates mae, rmse and mape; mape leaves out actuals of 0."""
    e = F.col("y_real") - F.col("y_pred")
    return [F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), (100 * F.avg(F.when(F.col("y_real") != 0, F.abs(e / F.col("y_real"))))).alias("mape")]


def scales(panel: DataFrame, until: DataFrame) -> DataFrame:
    """(series_id, mase_scale, rmsse_scale): error of the seasonal naive up to the period in ``until`` (t); null if 0."""
    d = F.col("y") - panels.lag(SEASON)
    rows = panel.withColumn("d", d).crossJoin(F.broadcast(until.select(F.col("t").alias("__until")))).where((F.col("t") <= F.col("__until")) & F.col("d").isNotNull())
    return rows.groupBy("series_id").agg(F.nullif(F.avg(F.abs("d")), F.lit(0.0)).alias("mase_scale"), F.nullif(F.avg(F.col("d") * F.col("d")), F.lit(0.0)).alias("rmsse_scale"))


def interval_score(coverage: float) -> Column:
    """Width plus 2 / alpha for each unit of a miss; smaller is better."""
    a = 1 - coverage
    return F.col("hi") - F.col("lo") + 2 / a * F.greatest(F.col("lo") - F.col("y_real"), F.lit(0.0)) + 2 / a * F.greatest(F.col("y_real") - F.col("hi"), F.lit(0.0))


def coverage_and_width(coverage: float) -> list[Column]:
    """Aggregates n, coverage, width and the tolerance of chance at 95 %."""
    inside = F.col("y_real").between(F.col("lo"), F.col("hi")).cast("double")
    return [F.count("*").alias("n"), F.avg(inside).alias("coverage"), F.avg(F.col("hi") - F.col("lo")).alias("width"), (1.96 * F.sqrt(F.lit(coverage * (1 - coverage)) / F.count("*"))).alias("tolerance")]


def by_series(predictions: DataFrame, scale: DataFrame, coverage: float, by: list[str]) -> DataFrame:
    """(by, series_id, level, n, mase, rmsse, covered, width, score)."""
    e = F.col("y_real") - F.col("y_pred")
    rows = predictions.join(scale, "series_id")
    inside = F.col("y_real").between(F.col("lo"), F.col("hi")).cast("double")
    return rows.groupBy(*by, "series_id", "level").agg(
        F.count("*").alias("n"), (F.avg(F.abs(e)) / F.first("mase_scale")).alias("mase"), F.sqrt(F.avg(e * e) / F.first("rmsse_scale")).alias("rmsse"),
        F.avg(inside).alias("covered"), F.avg(F.col("hi") - F.col("lo")).alias("width"), F.avg(interval_score(coverage)).alias("score"),
    )


def paired(a: DataFrame, b: DataFrame, scale: DataFrame, squared: bool = False) -> DataFrame:
    """(origin, horizon, series_id, level, a, b, d): scaled errors of two models on the same forecasts."""
    err = lambda df, name: df.select("origin", "horizon", "series_id", "level", (F.col("y_real") - F.col("y_pred")).alias(name))
    both = err(a, "a").join(err(b, "b").drop("level"), ["origin", "horizon", "series_id"]).join(scale, "series_id")
    f = (lambda c: F.col(c) * F.col(c) / F.col("rmsse_scale")) if squared else (lambda c: F.abs(F.col(c)) / F.col("mase_scale"))
    both = both.withColumns({"a": f("a"), "b": f("b")})
    return both.withColumn("d", F.col("b") - F.col("a")).where("d is not null").select("origin", "horizon", "series_id", "level", "a", "b", "d")


def paired_summary(pairs: DataFrame, by: list[str]) -> DataFrame:
    """(by, error_a, error_b, change, wins): mean scaled errors, the change of the second in percent, and how often it is better."""
    out = pairs.groupBy(*by).agg(F.avg("a").alias("error_a"), F.avg("b").alias("error_b"), F.avg((F.col("b") < F.col("a")).cast("double")).alias("wins"))
    return out.withColumn("change", 100 * (F.try_divide("error_b", "error_a") - 1))


def normal_tail(z: Column) -> Column:
    """P(Z > z) for z >= 0, to 1e-7."""
    x = z / math.sqrt(2)
    t = 1 / (1 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return 0.5 * poly * F.exp(-x * x)


def t_tail(t: Column, df: Column, parts: int = 400) -> Column:
    """P(T > t) for t >= 0: the share of the integral of cos^(df - 1) beyond atan(t / sqrt(df)), by Simpson's rule."""
    start = F.atan(t / F.sqrt(df))

    def integral(low: Column) -> Column:
        h = (F.lit(math.pi / 2) - low) / parts
        return h / 3 * F.aggregate(F.sequence(F.lit(0), F.lit(parts)), F.lit(0.0), lambda s, i: s + F.pow(F.greatest(F.cos(low + i * h), F.lit(0.0)), df - 1) * F.when(i.isin(0, parts), 1.0).when(i % 2 == 1, 4.0).otherwise(2.0))

    return integral(start) / (2 * integral(F.lit(0.0)))


#: Most differences of an exact signed-rank test.
EXACT = 50


def signed_rank_p(n: Column, w: Column) -> Column:
    """Two-sided p of the smaller rank sum ``w`` of ``n`` untied differences.

    How many of the 2^n sets of the ranks 1 to n have each sum, rank by rank: a set has the rank or it has not.
    """
    places = F.sequence(F.lit(1), F.floor(w).cast("int") + 1)
    counts = F.aggregate(F.sequence(F.lit(1), n), F.transform(places, lambda j: F.when(j == 1, 1.0).otherwise(0.0)), lambda c, rank: F.transform(c, lambda x, j: x + F.when(j >= rank, F.get(c, j - rank)).otherwise(0.0)))
    return F.least(2 * F.aggregate(counts, F.lit(0.0), lambda s, x: s + x) / F.pow(F.lit(2.0), n), F.lit(1.0))


def wilcoxon(pairs: DataFrame, by: list[str]) -> DataFrame:
    """(by, n, w, z, p): signed-rank test of d, zeros left out, mean ranks for ties.

    p is exact for up to ``EXACT`` differences without ties, else by the normal law.
    """
    rows = pairs.withColumn("d", F.round("d", 9)).where("d <> 0").withColumn("m", F.abs("d"))
    w = W.partitionBy(*by)
    # mean rank of a run of equal values: those below it, and half of the run
    at = rows.groupBy(*by, "m").agg(F.count("*").alias("ties"), F.count_if(F.col("d") > 0).alias("plus"))
    below = F.coalesce(F.sum("ties").over(w.orderBy("m").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    at = at.withColumn("rank", below + (F.col("ties") + 1) / 2)
    out = at.groupBy(*by).agg(F.sum("ties").alias("n"), F.sum(F.col("rank") * F.col("plus")).alias("up"), F.sum(F.col("rank") * (F.col("ties") - F.col("plus"))).alias("down"), F.sum(F.pow("ties", F.lit(3)) - F.col("ties")).alias("tied"))
    n = F.col("n").cast("double")
    low = F.least("up", "down")
    z = F.try_divide(low - n * (n + 1) / 4, F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("tied") / 48))
    return out.select(*by, "n", low.alias("w"), z.alias("z"), F.when((F.col("n") <= EXACT) & (F.col("tied") == 0), signed_rank_p(F.col("n").cast("int"), low)).otherwise(F.least(2 * normal_tail(F.abs(z)), F.lit(1.0))).alias("p"))


def diebold_mariano(pairs: DataFrame, by: list[str], lags: int) -> DataFrame:
    """(by, n, statistic, p): loss differences averaged by origin, Newey-West variance, small-sample factor."""
    d = pairs.groupBy(*by, "origin").agg(F.avg("d").alias("d"))
    w = W.partitionBy(*by)
    d = d.withColumn("c", F.col("d") - F.avg("d").over(w))
    products = {f"g{k}": F.col("c") * F.lag("c", k).over(w.orderBy("origin")) for k in range(lags + 1)}
    one = d.withColumns(products).groupBy(*by).agg(F.count("*").alias("n"), F.avg("d").alias("mean"), *(F.coalesce(F.sum(f"g{k}"), F.lit(0.0)).alias(f"g{k}") for k in range(lags + 1)))
    n = F.col("n").cast("double")
    variance = F.col("g0") / n
    for k in range(1, lags + 1):
        variance = variance + 2 * (1 - k / (lags + 1)) * F.col(f"g{k}") / n
    h = lags + 1
    factor = F.sqrt((n + 1 - 2 * h + h * (h - 1) / n) / n)
    stat = F.when(variance > 0, F.col("mean") / F.sqrt(variance / n) * factor)
    one = one.withColumn("statistic", stat)
    return one.select(*by, "n", "statistic", F.coalesce(2 * t_tail(F.abs("statistic"), n - 1), F.lit(1.0)).alias("p"))


def holm(tests: DataFrame, family: list[str], p: str, tie: str) -> DataFrame:
    """``tests`` with ``adjusted``: step-down within each family."""
    w = W.partitionBy(*family)
    r = F.row_number().over(w.orderBy(p, tie))
    one = tests.withColumn("__x", F.least((F.count("*").over(w) - r + 1) * F.col(p), F.lit(1.0)))
    return one.withColumn("adjusted", F.max("__x").over(w.orderBy(p, tie).rowsBetween(W.unboundedPreceding, 0))).drop("__x")


def select_model(table: DataFrame, baseline: str) -> DataFrame:
    """(model, rule): the least error among models that beat the baseline at both levels and are calibrated at both;
    else the most accurate that beats it; else the baseline.

    ``table`` has (model, error_total, error_leaf, calibrated_total, calibrated_leaf), one row per model.
    """
    base = table.where(F.col("model") == baseline).select(F.col("error_total").alias("__t"), F.col("error_leaf").alias("__l"))
    at = table.crossJoin(F.broadcast(base))
    beats = (F.col("error_total") < F.col("__t")) & (F.col("error_leaf") < F.col("__l"))
    rule = F.when(F.col("model") == baseline, F.lit(3)).when(beats & F.col("calibrated_total") & F.col("calibrated_leaf"), 1).when(beats, 2)
    best = at.withColumn("rank", rule).where("rank is not null").orderBy("rank", F.col("error_total") + F.col("error_leaf"), "model").limit(1)
    return best.select("model", F.element_at(F.array(F.lit("calibrated"), F.lit("most accurate"), F.lit("baseline")), F.col("rank")).alias("rule"))


def autocorrelation(panel: DataFrame, lags: int) -> DataFrame:
    """(series_id, n, band, acf): autocorrelations 0 to ``lags`` as an array."""
    w = W.partitionBy("series_id")
    c = panel.withColumn("c", F.col("y") - F.avg("y").over(w)).withColumn("n", F.count("*").over(w))
    products = {f"p{k}": F.col("c") * F.lag("c", k).over(w.orderBy("t")) for k in range(lags + 1)}
    sums = c.withColumns(products).groupBy("series_id").agg(F.first("n").alias("n"), *(F.coalesce(F.sum(f"p{k}"), F.lit(0.0)).alias(f"p{k}") for k in range(lags + 1)))
    return sums.select("series_id", "n", (1.96 / F.sqrt(F.col("n"))).alias("band"), F.array(*(F.try_divide(f"p{k}", "p0") for k in range(lags + 1))).alias("acf"))


def partial_autocorrelation(acf: Column, lags: int) -> Column:
    """Array of partial autocorrelations 1 to ``lags`` by Durbin and Levinson's recursion."""
    total = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)

    def step(state: Column, k: Column) -> Column:
        seg = F.slice(acf, F.lit(2), k - 1)
        num = F.element_at(acf, k + 1) - total(state["phi"], F.reverse(seg))
        new = num / (1 - total(state["phi"], seg))
        phi = F.concat(F.zip_with(state["phi"], F.reverse(state["phi"]), lambda x, y: x - new * y), F.array(new))
        return F.struct(phi.alias("phi"), F.array_append(state["out"], new).alias("out"))

    empty = F.array().cast("array<double>")
    return F.aggregate(F.sequence(F.lit(1), F.lit(lags)), F.struct(empty.alias("phi"), empty.alias("out")), step, lambda s: s["out"])


#: 5 % critical value of the Dickey-Fuller statistic with a constant, and (statistic, p) of KPSS with a constant.
DF_CRITICAL = -2.86
KPSS_TABLE = ((0.347, 0.10), (0.463, 0.05), (0.574, 0.025), (0.739, 0.01))


def kpss_p(statistic: Column) -> Column:
    """p between the table's ends, by straight lines."""
    p = F.when(statistic <= KPSS_TABLE[0][0], KPSS_TABLE[0][1])
    for (x0, p0), (x1, p1) in zip(KPSS_TABLE, KPSS_TABLE[1:]):
        p = p.when(statistic <= x1, p0 + (statistic - x0) * ((p1 - p0) / (x1 - x0)))
    return p.when(statistic > KPSS_TABLE[-1][0], KPSS_TABLE[-1][1])


def _newton(x: np.ndarray, y: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Coefficients of the Poisson regression of counts that are not all 0; a step that is no gain is halved."""
    gain = lambda b: float(y @ (x @ b) - np.exp(np.clip(x @ b, -60, 60)).sum())
    beta = start
    for _ in range(100):
        mean = np.exp(np.clip(x @ beta, -60, 60))
        step = np.linalg.lstsq((x * mean[:, None]).T @ x, x.T @ (y - mean), rcond=1e-12)[0]
        for _ in range(30):
            if gain(beta + step) >= gain(beta) - 1e-9 * abs(gain(beta)):
                break
            step = step / 2
        beta = beta + step
        if np.abs(step).max() < 1e-12:
            break
    return beta


def harmonic_fits(panel: DataFrame, harmonics: int) -> DataFrame:
    """(series_id, level, harmonics, deviance, fitted): Poisson regressions of each series on 0 to ``harmonics`` harmonics.

    ``fitted`` lists the sums of each term (one, sin_1, cos_1, ...) times the fitted mean, which at the maximum are
    those times the counts. A series' periods meet in one task; missing counts are left out; a series of zeros has a
    deviance of 0.
    """
    terms = calendar.fourier(F.col("week"), harmonics)
    rows = panel.where("y is not null").select("series_id", "level", "t", F.col("y").cast("double").alias("y"), F.array(F.lit(1.0), *terms.values()).alias("x"))

    def fits(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("t")
        x, y, out = np.stack(part["x"]), part["y"].to_numpy(), []
        beta = np.array([np.log(max(y.mean(), 1e-9))])
        for k in range(harmonics + 1):
            use = x[:, : 1 + 2 * k]
            mean = np.zeros(len(y))
            if y.any():
                beta = _newton(use, y, np.concatenate([beta, np.zeros(use.shape[1] - len(beta))]))
                mean = np.exp(np.clip(use @ beta, -60, 60))
            logs = np.where(y > 0, y * np.log(np.where(y > 0, y, 1) / np.maximum(mean, 1e-300)), 0)
            out.append((part["series_id"].iloc[0], part["level"].iloc[0], k, 2 * float((logs - y + mean).sum()), (use.T @ mean).tolist()))
        return pd.DataFrame(out, columns=["series_id", "level", "harmonics", "deviance", "fitted"])

    return rows.groupBy("series_id").applyInPandas(fits, "series_id string, level string, harmonics int, deviance double, fitted array<double>")


def harmonic_test(fits: DataFrame) -> DataFrame:
    """(series_id, level, harmonics, deviance, ratio, p): the gain of each further harmonic and its chi-square tail of two degrees."""
    ratio = F.lag("deviance").over(W.partitionBy("series_id").orderBy("harmonics")) - F.col("deviance")
    return fits.withColumn("ratio", F.greatest(ratio, F.lit(0.0))).withColumn("ratio", F.when(F.col("harmonics") > 0, F.col("ratio"))).withColumn("p", F.exp(-F.col("ratio") / 2)).select("series_id", "level", "harmonics", "deviance", "ratio", "p")


def stationarity(panel: DataFrame) -> DataFrame:
    """(series_id, kind, n, df, unit_root, kpss, kpss_p) of each series' level and first difference.

    ``df`` is the Dickey-Fuller statistic with a constant and one lagged difference, by the moments of its regression;
    ``unit_root`` says that it does not fall under the 5 % critical value. KPSS is that with a constant and five lags.
    """
    w = W.partitionBy("series_id").orderBy("t")
    y = F.col("y").cast("double")
    moved = panel.withColumn("before", F.lag("y").over(w).cast("double"))
    both = moved.select("series_id", "t", F.explode(F.array(F.struct(F.lit("level").alias("kind"), y.alias("v")), F.struct(F.lit("difference").alias("kind"), (y - F.col("before")).alias("v")))).alias("s")).select("series_id", "t", "s.*").where("v is not null")
    k = W.partitionBy("series_id", "kind")
    o = k.orderBy("t")
    rows = both.withColumn("x", F.lag("v").over(o)).withColumn("dv", F.col("v") - F.col("x"))
    rows = rows.withColumn("z", F.lag("dv").over(o)).where("z is not null")
    s = lambda a, b: F.covar_pop(a, b) * F.count("*")
    m = rows.groupBy("series_id", "kind").agg(F.count("*").alias("m"), *(s(a, b).alias(a + b) for a, b in (("x", "x"), ("x", "z"), ("z", "z"), ("x", "dv"), ("z", "dv"), ("dv", "dv"))))
    det = F.col("xx") * F.col("zz") - F.col("xz") * F.col("xz")
    slope = (F.col("zz") * F.col("xdv") - F.col("xz") * F.col("zdv")) / det
    other = (F.col("xx") * F.col("zdv") - F.col("xz") * F.col("xdv")) / det
    rest = F.col("dvdv") - slope * F.col("xdv") - other * F.col("zdv")
    df = m.where(det > 0).select("series_id", "kind", F.try_divide(slope, F.sqrt(rest / (F.col("m") - 3) * F.col("zz") / det)).alias("df"))
    c = both.withColumn("c", F.col("v") - F.avg("v").over(k))
    c = c.withColumn("s", F.sum("c").over(o.rowsBetween(W.unboundedPreceding, 0)))
    lags = 5
    c = c.withColumns({f"p{i}": F.col("c") * F.lag("c", i).over(o) for i in range(lags + 1)})
    one = c.groupBy("series_id", "kind").agg(F.count("*").alias("n"), F.sum(F.col("s") * F.col("s")).alias("ss"), *(F.coalesce(F.sum(f"p{i}"), F.lit(0.0)).alias(f"p{i}") for i in range(lags + 1)))
    count = F.col("n").cast("double")
    variance = F.col("p0") / count
    for i in range(1, lags + 1):
        variance = variance + 2 * (1 - i / (lags + 1)) * F.col(f"p{i}") / count
    one = one.select("series_id", "kind", "n", F.try_divide("ss", count * count * variance).alias("kpss"))
    return one.join(df.hint("merge"), ["series_id", "kind"], "left").select("series_id", "kind", "n", "df", (F.col("df") >= DF_CRITICAL).alias("unit_root"), "kpss", kpss_p(F.col("kpss")).alias("kpss_p"))


def strengths(panel: DataFrame, half: int = SEASON // 2) -> DataFrame:
    """(series_id, trend_strength, seasonal_strength) from a centred moving mean and seasonal means."""
    w = W.partitionBy("series_id").orderBy("t").rowsBetween(-half, half)
    rows = panel.withColumns({"trend": F.avg("y").over(w), "n": F.count("*").over(w)}).where(F.col("n") == 2 * half + 1)
    rows = rows.withColumn("detrended", F.col("y") - F.col("trend"))
    rows = rows.withColumn("seasonal", F.avg("detrended").over(W.partitionBy("series_id", "week")) - F.avg("detrended").over(W.partitionBy("series_id")))
    rows = rows.withColumn("rest", F.col("detrended") - F.col("seasonal"))
    strength = lambda c: F.greatest(1 - F.try_divide(F.var_pop("rest"), F.var_pop(F.col(c) + F.col("rest"))), F.lit(0.0))
    return rows.groupBy("series_id").agg(strength("trend").alias("trend_strength"), strength("seasonal").alias("seasonal_strength"))
