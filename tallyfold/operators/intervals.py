"""Prediction intervals: conformal bounds by level, dispersion, quantiles of counts."""

from __future__ import annotations

from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfold.operators import selection


def scale(pred: Column) -> Column:
    """Root of the expected level, 1 at least."""
    return F.sqrt(F.greatest(pred, F.lit(1.0)))


def conformal_bounds(scores: DataFrame, by: list[str], score: str, coverage: float) -> DataFrame:
    """(by, n, low, high, valid): the order statistics that a finite sample asks for."""
    a = 1 - coverage
    # rounding keeps 0.1 * 10 from falling just under 1
    ends = lambda n: [F.floor(F.round((n + 1) * a / 2, 9)), F.ceil(F.round((n + 1) * (1 - a / 2), 9))]
    found = selection.order_statistics(scores, by, score, ends)
    k_low, k_high = ends(F.col("n"))
    return found.select(*by, "n", F.col("values")[0].alias("low"), F.col("values")[1].alias("high"), ((k_low >= 1) & (k_high <= F.col("n"))).alias("valid"))


def recent(errors: DataFrame, at: DataFrame, width: int = 26) -> DataFrame:
    """``errors`` (t, ...) with ``origin``: the rows of the ``width`` periods up to each origin; a row per origin that it is near."""
    # a dozen origins or so
    return errors.join(F.broadcast(at.select("origin")), (F.col("t") > F.col("origin") - width) & (F.col("t") <= F.col("origin")))


def conformal(predictions: DataFrame, calibration: DataFrame, coverage: float = 0.8, by: tuple[str, ...] = ("origin", "level")) -> DataFrame:
    """``predictions`` with bounds from the calibration rows (by, y_real, y_pred) of the same origin and level."""
    scores = calibration.withColumn("score", (F.col("y_real") - F.col("y_pred")) / scale(F.col("y_pred")))
    bounds = conformal_bounds(scores, list(by), "score", coverage).select(*by, "low", "high")
    # a row for each origin and level
    rows = predictions.drop("lo", "hi").join(F.broadcast(bounds), list(by))
    lo = F.greatest(F.col("y_pred") + F.col("low") * scale(F.col("y_pred")), F.lit(0.0))
    rows = rows.withColumn("lo", lo)
    return rows.withColumn("hi", F.greatest(F.col("y_pred") + F.col("high") * scale(F.col("y_pred")), F.col("lo"))).drop("low", "high")


def dispersion(predictions: DataFrame, least: int = 10) -> DataFrame:
    """(series_id, phi): Pearson dispersion of past predictions, 1 at least; series with few points get the pooled one."""
    x = F.pow(F.col("y_real") - F.col("y_pred"), 2) / F.col("y_pred")
    rows = predictions.where("y_pred > 0").withColumn("x", x)
    pooled = rows.agg(F.avg("x").alias("p"))
    own = rows.groupBy("series_id").agg(F.avg("x").alias("x"), F.count("*").alias("n"))
    return own.crossJoin(F.broadcast(pooled)).select("series_id", F.greatest(F.when(F.col("n") >= least, F.col("x")).otherwise(F.col("p")), F.lit(1.0)).alias("phi"))


def log_gamma(x: Column) -> Column:
    """Stirling's series after moving the argument up by 8."""
    z = x + 8
    shift = F.log(x)
    for k in range(1, 8):
        shift = shift + F.log(x + k)
    return (z - 0.5) * F.log(z) - z + 0.9189385332046727 + 1 / (12 * z) - 1 / (360 * z * z * z) + 1 / (1260 * F.pow(z, F.lit(5))) - shift


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """As ``log_gamma``, for arrays."""
    z = x + 8
    shift = sum(np.log(x + k) for k in range(8))
    return (z - 0.5) * np.log(z) - z + 0.9189385332046727 + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - shift


def _run(n: int, step, *state: np.ndarray) -> np.ndarray:
    """Repeats ``step(i, *state)`` until each row's last state moves by no more than rounding, ``n`` times at most; rows that are done leave."""
    out, live = state[-1].copy(), np.arange(len(state[-1]))
    for i in range(1, n + 1):
        new = step(i, live, *state)
        done = np.abs(new[-1] - state[-1]) <= 2e-16 * np.abs(new[-1])
        out[live] = new[-1]
        state, live = tuple(x[~done] for x in new), live[~done]
        if not len(live):
            break
    return out


def _not_zero(x: np.ndarray) -> np.ndarray:
    return np.where(np.abs(x) < 1e-300, 1e-300, x)


def upper_gamma(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The regularised upper incomplete gamma function for a > 0 and x > 0: a series below a + 1, a continued fraction beyond."""
    out, low = np.empty(len(a)), x < a + 1
    n = 100 + int(12 * np.sqrt(a.max(initial=0)))
    front = np.exp(a * np.log(x) - x - _log_gamma(a))

    def term(i, live, t, total, a=a[low], x=x[low]):
        t = t * x[live] / (a[live] + i)
        return t, total + t

    def lentz(i, live, c, d, h, a=a[~low], x=x[~low]):
        numerator, b = -i * (i - a[live]), x[live] + 1 - a[live] + 2 * i
        d, c = 1 / _not_zero(numerator * d + b), _not_zero(b + numerator / c)
        return c, d, h * d * c

    out[low] = 1 - front[low] * _run(n, term, 1 / a[low], 1 / a[low])
    first = 1 / (x[~low] + 1 - a[~low])
    out[~low] = front[~low] * _run(n, lentz, np.full(len(first), 1e300), first, first.copy())
    return out


def lower_beta(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The regularised incomplete beta function for 0 < x < 1, a > 0 and b > 0, by the continued fraction on its fast side."""
    turned = x >= (a + 1) / (a + b + 2)
    x, a, b = np.where(turned, 1 - x, x), np.where(turned, b, a), np.where(turned, a, b)
    front = np.exp(_log_gamma(a + b) - _log_gamma(a) - _log_gamma(b) + a * np.log(x) + b * np.log1p(-x)) / a

    def lentz(m, live, c, d, h):
        x_, a_, b_ = x[live], a[live], b[live]
        for numerator in (m * (b_ - m) * x_ / ((a_ + 2 * m - 1) * (a_ + 2 * m)), -(a_ + m) * (a_ + b_ + m) * x_ / ((a_ + 2 * m) * (a_ + 2 * m + 1))):
            d, c = 1 / _not_zero(1 + numerator * d), _not_zero(1 + numerator / c)
            h = h * d * c
        return c, d, h

    first = 1 / _not_zero(1 - (a + b) * x / (a + 1))
    got = front * _run(100 + int(6 * np.sqrt(np.maximum(a, b).max(initial=0))), lentz, np.ones(len(a)), first, first.copy())
    return np.where(turned, 1 - got, got)


def count_cdf(k: np.ndarray, m: np.ndarray, f: np.ndarray) -> np.ndarray:
    """P(count <= k) for mean ``m``: Poisson where ``f`` is 1, else negative binomial of variance f * m; 0 under k = 0."""
    out, own, spread = np.zeros(len(k)), (k >= 0) & (f <= 1), (k >= 0) & (f > 1)
    out[own] = upper_gamma(k[own] + 1.0, m[own])
    out[spread] = lower_beta(1 / f[spread], m[spread] / (f[spread] - 1), k[spread] + 1.0)
    return out


#: Means from which quantiles come from an expansion about the normal law; its error there is under a thousandth of a count.
LARGE_MEAN = 1e6


def _least(share: float, m: np.ndarray, f: np.ndarray) -> np.ndarray:
    """The least count whose distribution function reaches ``share``: counts within twelve deviations of the mean are halved."""
    reach = 12 * np.sqrt(f * m) + 30 * f
    lo, hi = np.maximum(np.floor(m - reach), 0), np.ceil(m + reach)
    while len(open_ := np.flatnonzero(lo < hi)):
        middle = np.floor((lo[open_] + hi[open_]) / 2)
        enough = count_cdf(middle, m[open_], f[open_]) >= share
        hi[open_[enough]], lo[open_[~enough]] = middle[enough], middle[~enough] + 1
    return hi


def _expanded(share: float, m: np.ndarray, f: np.ndarray) -> np.ndarray:
    z = NormalDist().inv_cdf(share)
    skew, more = (2 * f - 1) / np.sqrt(f * m), 6 * (f - 1) / m + 1 / (f * m)
    w = z + skew * (z * z - 1) / 6 + more * (z**3 - 3 * z) / 24 - skew * skew * (2 * z**3 - 5 * z) / 36
    return np.ceil(m + np.sqrt(f * m) * w - 0.5)


def count_interval(mu: Column, phi: Column, coverage: float = 0.8) -> Column:
    """struct(lo, hi, covered): the central interval of a Poisson (phi <= 1) or negative binomial count.

    ``covered`` is the probability of the closed interval. Variance is phi times the mean. Quantiles are found by halving
    the counts on the distribution function, an incomplete gamma or beta function, so a row costs the root of its mean
    and makes no other rows. Means from ``LARGE_MEAN`` on take the expansion of Cornish and Fisher, and are covered as
    asked to 1 / their standard deviation. A null mean or dispersion gives nulls.
    """
    a = (1 - coverage) / 2

    @F.pandas_udf("lo long, hi long, covered double")
    def interval(mean: pd.Series, spread: pd.Series) -> pd.DataFrame:
        known = (mean.notna() & spread.notna()).to_numpy()
        m, f = np.maximum(mean.to_numpy(np.float64)[known], 1e-9), np.maximum(spread.to_numpy(np.float64)[known], 1.0)
        large = m >= LARGE_MEAN
        ends = []
        for share in (a, 1 - a):
            k = np.empty(len(m))
            k[large], k[~large] = _expanded(share, m[large], f[large]), _least(share, m[~large], f[~large])
            ends.append(k)
        covered = np.full(len(m), coverage)
        lo, hi, m, f = ends[0][~large], ends[1][~large], m[~large], f[~large]
        covered[~large] = count_cdf(hi, m, f) - count_cdf(lo - 1, m, f)
        out = pd.DataFrame({"lo": ends[0].astype(np.int64), "hi": ends[1].astype(np.int64), "covered": covered}, index=np.flatnonzero(known))
        return out.reindex(range(len(known))).astype({"lo": "Int64", "hi": "Int64"})

    return interval(mu.cast("double"), phi.cast("double"))


def count_quantiles(rows: DataFrame, key: str, mu: str, phi: str, coverage: float = 0.8) -> DataFrame:
    """(key, lo, hi, covered) by ``count_interval``."""
    return rows.select(F.col(key), count_interval(F.col(mu), F.col(phi), coverage).alias("__i")).select(key, "__i.lo", "__i.hi", "__i.covered")
