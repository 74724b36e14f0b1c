"""Many Poisson regressions at once: one for each origin and horizon, on the supervised rows of all series.

A regression has an intercept, a coefficient for each feature and a term for each series. The terms of the series are
eliminated where their rows are: given the coefficients, a series' best term solves an equation of one unknown, and what
is left of the normal equations is the Schur complement of the (diagonal) block of the series. So every round is one
job: tasks that hold whole series add up features squared numbers for each regression, Spark adds up the tasks' sums,
and the driver solves systems as small as the number of features, however many series and rows there are.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfold.operators import intervals
from tallyfold.sources import shared

Cell = tuple[int, int, int]
LEAST_ROWS = 10
#: Times that a step may be halved.
_HALVINGS = 8


class Fit(NamedTuple):
    #: Intercept and features of each cell.
    beta: dict[Cell, np.ndarray]
    #: (series_id, horizon, until, term): a row for each series of each regression.
    terms: DataFrame


def scaling(rows: DataFrame, names: list[str], until: int) -> list[tuple[float, float]]:
    """Mean and standard deviation (1 where it is 0) of each feature in rows up to period ``until``."""
    known = rows.where(F.col("t") <= until)
    facts = known.agg(*(F.avg(n).alias(f"m_{n}") for n in names), *(F.stddev_pop(n).alias(f"s_{n}") for n in names)).first()
    return [(float(facts[f"m_{n}"] or 0.0), float(facts[f"s_{n}"] or 0.0) or 1.0) for n in names]


def scaled(rows: DataFrame, names: list[str], by: list[tuple[float, float]]) -> DataFrame:
    """``rows`` with ``x``, the features less their mean, by their deviation."""
    return rows.withColumn("x", F.array(*(((F.col(n) - F.lit(m)) / F.lit(s)).cast("double") for n, (m, s) in zip(names, by))))


def design(rows: DataFrame, names: list[str], until: int) -> DataFrame:
    """``rows`` with ``x``, the features scaled by what rows up to period ``until`` show."""
    return scaled(rows, names, scaling(rows, names, until))


def series_term(total: np.ndarray, expected: np.ndarray, penalty: np.ndarray) -> np.ndarray:
    """The best term of a series: the root of total - exp(term) * expected - penalty * term, by Newton's steps."""
    expected, term = np.maximum(expected, 1e-300), np.log((total + 0.5) / np.maximum(expected, 1e-300))
    for _ in range(60):
        mean = np.exp(np.clip(term, -700, 700)) * expected
        step = (total - mean - penalty * term) / (mean + penalty)
        term = term + np.clip(step, -4, 4)
        if np.abs(step).max(initial=0) < 1e-13:
            break
    return term


def _series(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[str, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(series, horizon, t, x, y), by t, from batches that are sorted by series, horizon and t."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        if batch.empty:
            continue
        held.append(batch)
        rows = pd.concat(held, ignore_index=True) if len(held) > 1 else batch
        *full, last = list(rows.groupby(["series_id", "horizon"], sort=False))
        held = [last[1]]
        for (name, horizon), part in full:
            yield name, int(horizon), part["t"].to_numpy(), np.stack(part["x"]), part["y"].to_numpy(np.float64)
    for part in held:
        yield part["series_id"].iloc[0], int(part["horizon"].iloc[0]), part["t"].to_numpy(), np.stack(part["x"]), part["y"].to_numpy(np.float64)


class _Regressions(NamedTuple):
    """What a pass over the rows needs."""

    cells: list[Cell]
    beta: np.ndarray
    #: Of each cell: its number of rows, times ``ridge``.
    penalty: np.ndarray

    def passes(self, batches: Iterator[pd.DataFrame]):
        """(series, cell numbers, ends of their rows, terms, x with intercept, y, exp(x beta) by cell) of each series and horizon."""
        by_horizon: dict[int, list[int]] = {}
        for number, cell in enumerate(self.cells):
            by_horizon.setdefault(cell[1], []).append(number)
        for name, horizon, t, x, y in _series(batches):
            numbers = np.array(by_horizon.get(horizon, []), np.int64)
            ends = np.searchsorted(t, [self.cells[k][2] for k in numbers], "right")
            numbers, ends = numbers[ends > 0], ends[ends > 0]
            if not len(numbers):
                continue
            full = np.concatenate([np.ones((len(y), 1)), x], 1)
            mean = np.exp(np.clip(full @ self.beta[numbers].T, -60, 60))
            run, total = np.cumsum(mean, 0), np.cumsum(y)
            terms = series_term(total[ends - 1], run[ends - 1, np.arange(len(numbers))], self.penalty[numbers])
            yield name, numbers, ends, terms, full, y, mean

    def sums(self, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """(cell, sums): log-likelihood, gradient and Schur complement by cell."""
        held: dict[int, np.ndarray] = {}
        for _, numbers, ends, terms, full, y, mean in self.passes(batches):
            for place, (number, n, term) in enumerate(zip(numbers.tolist(), ends.tolist(), terms.tolist())):
                a, mu, r = full[:n], np.exp(term) * mean[:n, place], self.penalty[number]
                weighted = a * mu[:, None]
                b = weighted.sum(0)
                left = a.T @ weighted - np.outer(b, b) / (mu.sum() + r)
                like = (y[:n] * (np.log(mean[:n, place]) + term) - mu).sum() - r / 2 * term**2
                got = np.concatenate([[like], a.T @ (y[:n] - mu), left.ravel()])
                held[number] = held[number] + got if number in held else got
        yield pd.DataFrame([(k, v.tobytes()) for k, v in held.items()], columns=["cell", "sums"])

    def terms(self, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for name, numbers, _, terms, *_ in self.passes(batches):
            of = [self.cells[k] for k in numbers]
            yield pd.DataFrame({"series_id": name, "horizon": [c[1] for c in of], "until": [c[2] for c in of], "term": terms})


def _added(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        for cell, sums in zip(batch["cell"], batch["sums"]):
            got = np.frombuffer(bytes(sums))
            held[cell] = held[cell] + got if cell in held else got
    yield pd.DataFrame([(k, v.tobytes()) for k, v in held.items()], columns=["cell", "sums"])


def fit(rows: DataFrame, cells: list[Cell], ridge: float = 1e-4, rounds: int = 25, tolerance: float = 1e-9) -> Fit:
    """Coefficients of each cell (origin, horizon, last period of its training rows), and the terms of its series.

    Penalised likelihood by Newton's steps, halved where they do not better it; the penalty is ``ridge`` a row and
    spares the intercept. What comes to the driver in a round is regressions times features squared.

    A regression is done when a step changes its fitted means by under ``tolerance`` of them (root of the mean square,
    weighted by the means). Coefficients are not asked: where features repeat each other, as a mean of lags does, only
    the penalty holds them, and they move by the rounding of the counts' sums over the penalty, more with larger counts.
    """
    data = rows.where("y is not null").select("series_id", "horizon", "t", "x", F.col("y").cast("double").alias("y"))
    # whole series to each task; a row for each horizon and period comes to the driver
    whole = data.repartition("series_id").sortWithinPartitions("series_id", "horizon", "t")
    found = data.groupBy("horizon", "t").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("y"), F.max(F.size("x")).alias("p")).toPandas()
    n, total = np.array([found.loc[(found["horizon"] == h) & (found["t"] <= u), ["n", "y"]].sum() for _, h, u in cells], float).reshape(-1, 2).T
    p = 1 + int(found["p"].max()) if len(found) else 1
    spared = np.concatenate([[0.0], np.ones(p - 1)])
    beta, before, best = np.zeros((len(cells), p)), np.zeros((len(cells), p)), np.full(len(cells), -np.inf)
    step, halved, done = np.zeros((len(cells), p)), np.zeros(len(cells), int), n == 0
    for _ in range(rounds):
        live = np.flatnonzero(~done)
        if not len(live):
            break
        now = _Regressions([cells[k] for k in live], beta[live], ridge * n[live])
        parts = whole.mapInPandas(now.sums, "cell int, sums binary").repartition("cell").mapInPandas(_added, "cell int, sums binary")
        for k, sums in parts.toPandas().itertuples(index=False):
            at, got = live[k], np.frombuffer(bytes(sums))
            penalty = ridge * n[at] * spared
            like = got[0] - (penalty * beta[at] ** 2).sum() / 2
            if like < best[at] - 1e-9 * abs(best[at]) and halved[at] < _HALVINGS:
                step[at], halved[at] = step[at] / 2, halved[at] + 1
                beta[at] = before[at] + step[at]
                continue
            best[at], before[at], halved[at] = like, beta[at].copy(), 0
            left = got[1 + p :].reshape(p, p)
            step[at] = np.linalg.solve(left + np.diag(penalty + 1e-12), got[1 : 1 + p] - penalty * beta[at])
            beta[at] = beta[at] + step[at]
            # fitted means add up to about the targets
            done[at] = step[at] @ left @ step[at] < tolerance**2 * max(total[at], 1.0)
    use = [k for k in range(len(cells)) if n[k]]
    last = _Regressions([cells[k] for k in use], beta[use], ridge * n[use])
    return Fit({cells[k]: beta[k] for k in use}, whole.mapInPandas(last.terms, "series_id string, horizon int, until int, term double"))


def _mean(width: int) -> Column:
    """exp of intercept and features of column ``beta``, and of the series' ``term``."""
    products = F.zip_with("x", F.slice("beta", 2, width), lambda a, b: a * b)
    eta = F.col("beta")[0] + F.aggregate(products, F.lit(0.0), lambda s, v: s + v) + F.coalesce("term", F.lit(0.0))
    return F.exp(F.least(F.greatest(eta, F.lit(-60.0)), F.lit(60.0)))


def predict(rows: DataFrame, fitted: Fit, cells: list[Cell], names: list[str], first: int, last: int) -> DataFrame:
    """``rows`` with ``origin`` and ``mu`` for each cell: its horizon's rows from period ``first`` to ``last`` after the end of its training.

    A series without training rows has no term of its own.
    """
    schema = "origin int, horizon int, until int, beta array<double>"
    table = rows.sparkSession.createDataFrame([(int(o), int(h), int(u), fitted.beta[o, h, u].tolist()) for o, h, u in cells if (o, h, u) in fitted.beta], schema)
    # one row per regression
    at = rows.join(F.broadcast(table), "horizon").where((F.col("t") >= F.col("until") + first) & (F.col("t") <= F.col("until") + last))
    at = at.join(fitted.terms.hint("shuffle_hash"), ["series_id", "horizon", "until"], "left")
    return at.withColumn("mu", _mean(len(names))).drop("beta", "until", "term")


def score_sums(rows: DataFrame, names: list[str], origins: list[int], horizons: list[int], ridge: float = 1e-4) -> DataFrame:
    """(origin, horizon, term, fitted): what the fit says of each sum that the score equations tie to the data.

    At the maximum of the penalised likelihood, the sum of feature times fitted mean over the training rows, plus the
    penalty's part, is the sum of feature times target; and each series' fitted sum, plus its part, is the sum of its
    targets. ``term`` names the feature or the series.
    """
    by = scaling(rows, names, min(origins))
    rows = scaled(rows.where("y is not null"), names, by)
    cells = [(o, h, o) for o in origins for h in horizons]
    fitted = fit(rows, cells, ridge)
    terms = shared.kept(fitted.terms, "series-terms")
    # from the first period on
    past = shared.kept(predict(rows, fitted._replace(terms=terms), cells, names, -max(origins) - 1, 0).select("origin", "horizon", "series_id", "mu", *names), "fitted-past")
    schema = "origin int, horizon int, pulls array<double>"
    pulls = rows.sparkSession.createDataFrame([(int(o), int(h), [float(b * s * ridge) for b, (_, s) in zip(beta[1:], by)]) for (o, h, _), beta in fitted.beta.items()], schema)
    sums = past.groupBy("origin", "horizon").agg(F.count(F.lit(1)).alias("n"), *(F.sum(F.col(n) * F.col("mu")).alias(n) for n in names))
    # a row for each regression
    whole = sums.join(F.broadcast(pulls), ["origin", "horizon"]).withColumns({n: F.col(n) + F.col("n") * F.col("pulls")[k] for k, n in enumerate(names)})
    own = past.groupBy("origin", "horizon", "series_id").agg(F.sum("mu").alias("own")).join(F.broadcast(sums.select("origin", "horizon", "n")), ["origin", "horizon"])
    own = own.join(terms.withColumnRenamed("until", "origin").hint("shuffle_hash"), ["origin", "horizon", "series_id"])
    own = own.select("origin", "horizon", F.col("series_id").alias("term"), (F.col("own") + ridge * F.col("n") * F.col("term")).alias("fitted"))
    return whole.unpivot(["origin", "horizon"], names, "term", "fitted").unionByName(own)


def forecasts(rows: DataFrame, names: list[str], origins: list[int], horizons: list[int], calibration: int = 26, coverage: float = 0.8, ridge: float = 1e-4) -> DataFrame:
    """(origin, horizon, series_id, level, service, t, y_real, y_pred, lo, hi, phi): fitted on targets up to each origin.

    The dispersion of a series is that of predictions of the last ``calibration`` periods by a regression that has not
    seen them; a series with under ``LEAST_ROWS`` of them gets that of all. Bounds are quantiles of counts.
    """
    rows = design(rows, names, min(origins) - calibration)
    full = [(o, h, o) for o in origins for h in horizons]
    inner = [(o, h, o - calibration) for o in origins for h in horizons]
    fitted = fit(rows, full + inner, ridge)
    fitted = fitted._replace(terms=shared.kept(fitted.terms, "series-terms"))
    past = predict(rows.where("y is not null"), fitted, inner, names, 1, calibration)
    x = F.pow(F.col("y") - F.col("mu"), 2) / F.col("mu")
    own = past.groupBy("origin", "horizon", "series_id").agg(F.avg(x).alias("own"), F.count("*").alias("n"))
    pooled = past.groupBy("origin", "horizon").agg(F.avg(x).alias("pooled"))
    # a row per regression, and per regression and series
    phi = own.join(F.broadcast(pooled), ["origin", "horizon"]).select("origin", "horizon", "series_id", F.greatest(F.when(F.col("n") >= LEAST_ROWS, F.col("own")).otherwise(F.col("pooled")), F.lit(1.0)).alias("phi"))
    ahead = None
    for h in horizons:
        part = predict(rows.where(F.col("horizon") == h), fitted, [c for c in full if c[1] == h], names, h, h)
        ahead = part if ahead is None else ahead.unionByName(part)
    out = ahead.join(phi.hint("shuffle_hash"), ["origin", "horizon", "series_id"], "left").withColumn("phi", F.coalesce("phi", F.lit(1.0)))
    out = out.withColumn("range", intervals.count_interval(F.col("mu"), F.col("phi"), coverage))
    return out.select("origin", "horizon", "series_id", "level", "service", "t", F.col("y").alias("y_real"), F.col("mu").alias("y_pred"), F.col("range.lo").cast("double").alias("lo"), F.col("range.hi").cast("double").alias("hi"), "phi")
