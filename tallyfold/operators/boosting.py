"""Boosted trees under Poisson loss for many training sets at once, from histograms that Spark sums.

Features are cut into bins once. A level of the current trees of all ensembles is one job: tasks sum gradients and
Hessians by (ensemble, node, feature, bin), and Spark sums the tasks' histograms by ensemble and finds the best cut of
each node there. So what a task of the second step reads is a histogram for each task of the first, and what comes to
the driver is a row for each ensemble and node, however many rows are fitted. The series is a category: its values are ordered by their gradient over their Hessian, and
cut in that order.

An ensemble is known by the last period of its training rows, so the rows of all are prefixes of one table in time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.sources import shared

BINS = 32
RIDGE, LEAST_ROWS = 1.0, 20
#: Rows of one task.
TASK_ROWS = 8192
FOUND = "cell int, feature int, node int, gain double, cut int, part array<int>, g double, h double, gl double, hl double"


@dataclass
class Settings:
    trees: int = 16
    depth: int = 3
    rate: float = 0.35
    #: Scores are written anew after so many trees, so that tasks apply few.
    keep: int = 4


@dataclass
class Tree:
    """A full binary tree; node i has the children 2i + 1 and 2i + 2. A node without a feature sends all rows left."""

    depth: int
    feature: np.ndarray = field(init=False)
    cut: np.ndarray = field(init=False)
    parts: dict[int, np.ndarray] = field(init=False)
    leaf: np.ndarray = field(init=False)

    def __post_init__(self):
        inner = (1 << self.depth) - 1
        self.feature, self.cut, self.parts = np.full(inner, -1, np.int32), np.zeros(inner, np.int32), {}
        self.leaf = np.zeros(1 << self.depth)

    def nodes(self, bins: np.ndarray, code: np.ndarray, levels: int) -> np.ndarray:
        """The node of each row, ``levels`` under the root."""
        at = np.zeros(len(bins), np.int32)
        row = np.arange(len(bins))
        for _ in range(levels):
            f = self.feature[at]
            right = (f >= 0) & (bins[row, np.maximum(f, 0) % bins.shape[1]] > self.cut[at])
            for node, left in self.parts.items():
                here = at == node
                right[here] = ~np.isin(code[here], left)
            at = 2 * at + 1 + right
        return at

    def values(self, bins: np.ndarray, code: np.ndarray) -> np.ndarray:
        return self.leaf[self.nodes(bins, code, self.depth) - len(self.feature)]


def edges(rows: DataFrame, names: list[str], bins: int = BINS) -> list[list[float]]:
    """Upper ends of the bins of each feature but the last: quantiles that occur in the data."""
    asked = [k / bins for k in range(1, bins)]
    got = rows.agg(*(F.percentile_approx(F.col(n).cast("double"), asked, 1_000_000).alias(f"e{k}") for k, n in enumerate(names))).first()
    return [sorted(set(e or [])) for e in got]


def binned(rows: DataFrame, names: list[str], until: int, base: str) -> tuple[DataFrame, list[str], list[list[float]]]:
    """``rows`` with ``bins``, a byte for each feature, ``code``, the number of the series, and ``base``, the first score; written.

    Also the names of the series and the ends of the bins. Bins are cut by rows up to period ``until``. One name per series comes to the driver.
    """
    known = rows.where((F.col("t") <= until) & F.col("y").isNotNull())
    cuts = edges(known, names)
    series = sorted(r[0] for r in rows.select("series_id").distinct().collect())

    @F.pandas_udf("binary")
    def places(*columns: pd.Series) -> pd.Series:
        each = [np.searchsorted(e, c.to_numpy(np.float64), "left").astype(np.uint8) for c, e in zip(columns, cuts)]
        return pd.Series(list(map(bytes, np.stack(each, 1))))

    # bounded by the number of series
    table = rows.sparkSession.createDataFrame([(s, k) for k, s in enumerate(series)] or [("", 0)], "series_id string, code int")
    out = rows.join(F.broadcast(table), "series_id").withColumns({"bins": places(*(F.col(n).cast("double") for n in names)), "base": F.log(F.col(base) + 0.5)})
    return shared.kept(out, "binned"), series, cuts


def _matrix(bins: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(bins), np.uint8).reshape(len(bins), -1)


def _best(sums: np.ndarray, category: bool) -> tuple | None:
    """(gain, cut, part, g, h, gl, hl) of the best cut of a node by one feature; ``sums`` is (bin, (g, h, n))."""
    order = np.arange(len(sums))
    if category:
        order = np.lexsort((order, sums[:, 0] / (sums[:, 1] + RIDGE)))
        order = order[sums[order, 2] > 0]
    run = np.cumsum(sums[order], 0)
    if not len(run) or run[-1, 2] == 0:
        return None
    g, h, n = run[-1]
    gl, hl, nl = run.T
    gain = gl**2 / (hl + RIDGE) + (g - gl) ** 2 / (h - hl + RIDGE) - g**2 / (h + RIDGE)
    gain[(nl < LEAST_ROWS) | (n - nl < LEAST_ROWS)] = -np.inf
    at = int(np.argmax(gain))
    return float(gain[at]), at, order[: at + 1].tolist() if category else [], float(g), float(h), float(gl[at]), float(hl[at])


def _best_cuts(cell: int, total: np.ndarray, width: int, n_features: int, n_series: int) -> Iterator[tuple]:
    """A row of ``FOUND`` for each node that has rows; of equal gains the first feature's."""
    cut = width * n_features * BINS * 3
    by_bin, by_series = total[:cut].reshape(width, n_features, BINS, 3), total[cut:].reshape(width, n_series, 3)
    for node in range(width):
        tried = [(f, got) for f in range(n_features + 1) if (got := _best(by_bin[node, f] if f < n_features else by_series[node], f == n_features))]
        if tried:
            feature, found = max(tried, key=lambda x: (x[1][0], -x[0]))
            yield cell, feature, node, *found


class Ensembles:
    """One ensemble for each of ``until``, the last periods of their training rows."""

    def __init__(self, until: list[int], settings: Settings | None = None):
        self.until, self.settings = sorted(set(until)), settings or Settings()
        self.trees: list[list[Tree]] = [[] for _ in self.until]

    def _level(self, rows: DataFrame, now: list[Tree], done: int, level: int, n_series: int) -> pd.DataFrame:
        until, old, n_features = self.until, [t[done:] for t in self.trees], self.n_features

        def histograms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held: dict[int, np.ndarray] = {}
            width = 1 << level
            for batch in batches:
                if batch.empty:
                    continue
                t, y, code, bins = batch["t"].to_numpy(), batch["y"].to_numpy(np.float64), batch["code"].to_numpy(), _matrix(batch["bins"])
                score = np.frombuffer(b"".join(batch["score"])).reshape(len(t), -1)
                for e, last in enumerate(until):
                    use = np.flatnonzero(t <= last)
                    if not len(use):
                        continue
                    b, c = bins[use], code[use]
                    mu = np.exp(score[use, e] + sum((x.values(b, c) for x in old[e]), np.zeros(len(c))))
                    node = now[e].nodes(b, c, level) - (width - 1)
                    place = ((node[:, None] * n_features + np.arange(n_features)) * BINS + b).ravel()
                    own = node * n_series + c
                    sums = []
                    for at, size, times in ((place, width * n_features * BINS, n_features), (own, width * n_series, 1)):
                        sums.append(np.stack([np.bincount(at, None if w is None else np.repeat(w, times), size) for w in (mu - y[use], mu, None)], 1).ravel())
                    got = np.concatenate(sums)
                    held[e] = held[e] + got if e in held else got
            yield pd.DataFrame([(e, h.tobytes()) for e, h in held.items()], columns=["cell", "sums"])

        def best(part: pd.DataFrame) -> pd.DataFrame:
            total = np.sum([np.frombuffer(bytes(h)) for h in part["sums"]], 0)
            found = _best_cuts(int(part["cell"].iloc[0]), total, 1 << level, n_features, n_series)
            return pd.DataFrame(found, columns=["cell", "feature", "node", "gain", "cut", "part", "g", "h", "gl", "hl"])

        made = rows.select("t", "y", "code", "bins", "score").mapInPandas(histograms, "cell int, sums binary")
        return made.groupBy("cell").applyInPandas(best, FOUND).toPandas()

    def fit(self, rows: DataFrame, n_series: int) -> Ensembles:
        """``rows`` as made by ``binned``; those without ``y`` are left out."""
        s = self.settings
        self.n_features = len(rows.first()["bins"])
        n = len(self.until)

        @F.pandas_udf("binary")
        def same(base: pd.Series) -> pd.Series:
            return pd.Series([np.full(n, b).tobytes() for b in base])

        base = rows.where("y is not null").where(F.col("t") <= max(self.until)).select("t", F.col("y").cast("double").alias("y"), "code", "bins", same("base").alias("score"))
        data, done = shared.kept(base.repartition(-(-rows.count() // TASK_ROWS) or 1), "boosting"), 0
        for _ in range(s.trees):
            now = [Tree(s.depth) for _ in self.until]
            sums: list[dict[int, tuple[float, float]]] = [{} for _ in self.until]
            for level in range(s.depth):
                found = self._level(data, now, done, level, n_series)
                for r in found.itertuples():
                    at = (1 << level) - 1 + r.node
                    if r.gain > 1e-9:
                        now[r.cell].feature[at], now[r.cell].cut[at] = r.feature, r.cut
                        if r.feature == self.n_features:
                            now[r.cell].parts[at] = np.array(r.part, np.int32)
                        sums[r.cell][2 * at + 1], sums[r.cell][2 * at + 2] = (r.gl, r.hl), (r.g - r.gl, r.h - r.hl)
                    else:
                        sums[r.cell][2 * at + 1] = (r.g, r.h)
            for tree, at in zip(now, sums):
                first = len(tree.feature)
                for node, (g, h) in at.items():
                    if node >= first:
                        tree.leaf[node - first] = -s.rate * g / (h + RIDGE)
            for held, tree in zip(self.trees, now):
                held.append(tree)
            if len(self.trees[0]) - done == s.keep:
                data, done = shared.kept(self._scored(data, done), "boosting"), done + s.keep
        return self

    def _scored(self, data: DataFrame, done: int) -> DataFrame:
        trees = [t[done:] for t in self.trees]

        def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                if not batch.empty:
                    bins, code = _matrix(batch["bins"]), batch["code"].to_numpy()
                    more = np.stack([sum((x.values(bins, code) for x in of), np.zeros(len(code))) for of in trees], 1)
                    score = np.frombuffer(b"".join(batch["score"])).reshape(len(code), -1) + more
                    batch["score"] = [row.tobytes() for row in score]
                    yield batch

        return data.mapInPandas(add, data.schema)

    def roots(self, names: list[str], cuts: list[list[float]]) -> list[tuple[int, str, float, float, float]]:
        """(until, feature, cut, left, right): the first cut of each ensemble; of the series, how many of them go left.

        ``left`` and ``right`` are the values of the leaves of a first tree of depth 1.
        """
        first = [(u, t[0]) for u, t in zip(self.until, self.trees)]
        cut = lambda t: float(len(t.parts[0])) if t.feature[0] == self.n_features else cuts[t.feature[0]][t.cut[0]]
        return [(u, ([*names, "series"])[t.feature[0]], cut(t), float(t.leaf[0]), float(t.leaf[1])) for u, t in first if t.feature[0] >= 0]

    def predict(self, rows: DataFrame, cell: str = "until") -> DataFrame:
        """``rows`` (with ``bins``, ``code``, ``base``) with ``mu`` of the ensemble whose last period is in column ``cell``."""
        of = dict(zip(self.until, self.trees))

        @F.pandas_udf("double")
        def mean(until: pd.Series, bins: pd.Series, code: pd.Series, base: pd.Series) -> pd.Series:
            score = base.to_numpy(np.float64).copy()
            for last in set(until):
                here = (until == last).to_numpy()
                b, c = _matrix(bins[here]), code[here].to_numpy()
                score[here] += sum((x.values(b, c) for x in of[last]), np.zeros(len(c)))
            return pd.Series(np.exp(score))

        return rows.withColumn("mu", mean(F.col(cell), "bins", "code", "base"))
