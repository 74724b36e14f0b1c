"""Whitening of embeddings by refined eigenvectors of their covariance.

An entry c becomes the integer floor(256 * c). The covariance is taken over the distinct integer vectors, once each, in
exact arithmetic: each task centres its vectors by the rounded mean, multiplies, and adds up integers; the driver gets a
number for each pair of dimensions, corrects for what rounding the mean left over, and divides once. So the covariance
is rounded once, and is the same whatever the order of the tasks.

Its eigenvectors are found in float32 and corrected by iterations of matrix products in extended precision (Ogita and
Aishima 2018): with R = I - X'X and S = X'VX, X becomes X + XE, where E holds (S_ij + e_j R_ij) / (e_j - e_i), and R_ij / 2
for eigenvalues that cannot be told apart yet. Those are clusters: once their common subspace is accurate, the small
eigenproblem of V - mI on the cluster's columns is solved and its vectors are rotated (their 2019 extension), and the
iterations go on. Quadratic convergence makes a handful of rounds enough.

Cases: rows whose vector is null, empty, or holds null or non-finite entries take no part, nor do those whose length is
not the most frequent one (of equally frequent ones, the shorter); integers stop at ``MOST`` in size; rows that repeat an
id or a vector are rows of their own, and rows without an id stay; a component without variance has no whitened values;
with fewer dimensions than components there are as many components as dimensions; no rows give no rows. ``deviation`` is
exact, and null if no long can hold it. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.llm.common import settle

SCALE, MOST = 256, 1 << 53
COMPONENTS = 4
ROUNDS = 30
#: Eigenvalues that differ by no more than this share of the largest are always a cluster.
NEAR = 1e-13
#: Integers go to the driver in digits of so many bits.
DIGIT, DIGITS = 40, 4
_BLOCK = 8192


class Model(NamedTuple):
    n: int
    sums: list[int]
    #: By falling eigenvalue; ``vectors`` has a column for each.
    values: np.ndarray
    vectors: np.ndarray
    trace: float


def integers(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """``df`` with ``x``, the vectors as longs, without the rows that take no part."""
    v = F.col(vector)
    bad = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = df.where(v.isNotNull() & (F.size(v) > 0)).where(~bad)
    by_length = rows.groupBy(F.size(v).alias("d")).agg(F.count(F.lit(1)).alias("n"))
    # a row for each length
    d = by_length.orderBy(F.desc("n"), "d").limit(1).first()
    x = F.transform(v, lambda c: F.floor(F.greatest(F.least(SCALE * c.cast("double"), F.lit(float(MOST))), F.lit(-float(MOST)))))
    return rows.where(F.size(v) == (d["d"] if d else 0)).withColumn("x", x)


def _matrix(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _digits(total: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(at, d0, d1, ...): exact integers, each cut into digits that can be summed as longs."""
    rest, parts = total.ravel().astype(object), []
    for _ in range(DIGITS - 1):
        parts.append(np.array(rest & ((1 << DIGIT) - 1), np.int64))
        rest = rest >> DIGIT
    parts.append(np.array(rest, np.int64))
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(rest)), pa.int64()), *(pa.array(p) for p in parts)], ["at", *(f"d{k}" for k in range(DIGITS))])


def _summed(fit: DataFrame, of) -> list[int]:
    """Exact sums over the vectors: ``of`` maps a matrix of them to an array of integers."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for at in range(0, batch.num_rows, _BLOCK):
                got = of(_matrix(batch.column(0).slice(at, _BLOCK))).astype(object)
                total = got if total is None else total + got
        if total is not None:
            yield from _digits(total)

    digits = [f"d{k}" for k in range(DIGITS)]
    parts = fit.select("x").mapInArrow(sums, "at long, " + ", ".join(f"{d} long" for d in digits))
    # a number for each pair of dimensions
    got = parts.groupBy("at").agg(*(F.sum(d).alias(d) for d in digits)).toPandas().sort_values("at")
    return [sum(int(d) << DIGIT * k for k, d in enumerate(row)) for row in got[digits].itertuples(index=False)]


def _products(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """The sum of products of all pairs of centred entries, exactly."""
    y = x - centre
    if int(np.abs(y).max(initial=0)) ** 2 * len(y) < 1 << 53:
        f = y.astype(np.float64)
        return (f.T @ f).astype(np.int64)
    y = y.astype(object)
    return y.T @ y


def covariance(fit: DataFrame) -> tuple[int, list[int], np.ndarray]:
    """(n, sums, covariance) of the integer vectors ``x``: divisor n, rounded once to doubles."""
    n = fit.count()
    sums = _summed(fit, lambda x: x.astype(object).sum(0) if len(x) and int(np.abs(x).max()) > 1 << 40 else x.sum(0)) if n else []
    centre = [round(Fraction(s, n)) for s in sums]
    shift = np.array(centre, np.int64)
    d = len(sums)
    products = _summed(fit, lambda x: _products(x, shift)) if n else []
    left = [s - n * c for s, c in zip(sums, centre)]
    return n, sums, np.array([(n * products[i * d + j] - left[i] * left[j]) / n**2 for i in range(d) for j in range(d)]).reshape(d, d)


def clusters(values: np.ndarray, gap: float) -> list[np.ndarray]:
    """Places of neighbouring eigenvalues (sorted) that lie within ``gap`` of each other, two at least."""
    cut = np.flatnonzero(np.diff(values) > gap) + 1
    return [c for c in np.split(np.arange(len(values)), cut) if len(c) > 1]


def eigenvectors(v: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors as columns of a symmetric matrix."""
    size = float(np.abs(v).max(initial=0.0))
    if not size:
        return np.zeros(len(v)), np.eye(len(v))
    a = (v / size).astype(np.longdouble)
    x = np.linalg.eigh(a.astype(np.float32))[1].astype(np.longdouble)
    one = np.eye(len(a), dtype=np.longdouble)
    tiny = np.finfo(np.longdouble).eps * len(a)
    moved = np.inf
    for _ in range(rounds):
        r, s = one - x.T @ x, x.T @ a @ x
        # rounding that is not symmetric would be divided by small gaps
        s = (s + s.T) / 2
        e = np.diag(s) / (1 - np.diag(r))
        order = np.argsort(e, kind="stable")
        x, e, r, s = x[:, order], e[order], r[np.ix_(order, order)], s[np.ix_(order, order)]
        off = float(np.linalg.norm((s - np.diag(e)).astype(np.float64)))
        gap = max(2 * (off + float(np.linalg.norm(r.astype(np.float64)))), NEAR * float(np.abs(e).max()))
        apart = np.abs(e[None, :] - e[:, None]) > gap
        change = np.where(apart, (s + e[None, :] * r) / np.where(apart, e[None, :] - e[:, None], 1), r / 2)
        x = x + x @ change
        for c in clusters(e, gap):
            # shifted to its own middle, so that the cluster's small differences are all that is left
            middle = e[c].mean()
            inner = x[:, c].T @ (a @ x[:, c] - middle * x[:, c])
            if (scale := float(np.abs(inner).max())) > 0:
                inner = ((inner + inner.T) / (2 * scale)).astype(np.float64)
                x[:, c] = x[:, c] @ np.linalg.eigh(inner)[1].astype(np.longdouble)
        now = float(np.abs(change).max())
        # rounding is all that is left once a step is no smaller than half the one before
        if now < tiny or now < 1e-6 and now > moved / 2:
            break
        moved = now
    for _ in range(2):
        x = x + x @ (one - x.T @ x) / 2
    x = x / np.sqrt((x * x).sum(0))
    e = ((a @ x) * x).sum(0)
    order = np.argsort(-e, kind="stable")
    return (e[order] * size).astype(np.float64), x[:, order].astype(np.float64)


def fit(rows: DataFrame) -> tuple[Model, DataFrame]:
    """The model of the vectors ``x``, and the list that it is fitted on: each distinct vector once."""
    each = settle(rows.select("x").distinct(), "whitening-fit")
    n, sums, v = covariance(each)
    values, vectors = eigenvectors(v)
    return Model(n, sums, values, vectors, math.fsum(np.diag(v))), each


def _deviation(d: np.ndarray) -> list[int | None]:
    """Sums of squares by row, exactly; null where no long holds one."""
    if int(np.abs(d).max(initial=0)) ** 2 * d.shape[1] < 1 << 63:
        return (d.astype(np.int64) ** 2).sum(1).tolist()
    return [s if (s := int((row.astype(object) ** 2).sum())) < 1 << 63 else None for row in d]


def _spread(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n * x - sums, exactly."""
    if (int(np.abs(x).max(initial=0)) * n + max(map(abs, sums.tolist()), default=0)) < 1 << 62:
        return n * x.astype(np.int64) - sums.astype(np.int64)
    return n * x.astype(object) - sums


def project(rows: DataFrame, model: Model, k: int = COMPONENTS) -> DataFrame:
    """``rows`` with ``deviation`` and ``whitened``, an array of the first ``k`` components' values; ``x`` goes."""
    k = min(k, len(model.values))
    least = len(model.values) * np.finfo(np.float64).eps * (model.values[0] if k else 0.0)
    live = model.values[:k] > max(least, 0.0)
    weights = np.where(live, model.vectors[:, :k] / np.sqrt(np.where(live, model.values[:k], 1)), 0) if k else np.zeros((0, 0))
    n, sums = model.n, np.array(model.sums, object)
    columns = [c for c in rows.columns if c != "x"]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*columns).schema), "deviation long", "whitened array<double>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, _BLOCK):
                batch = whole.slice(at, _BLOCK)
                d = _spread(_matrix(batch.column("x")), n, sums)
                z = (d.astype(np.float64) / n) @ weights
                white = pa.array([[v if ok else None for v, ok in zip(row, live)] for row in z.tolist()], pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(_deviation(d), pa.int64()), white], [*columns, "deviation", "whitened"])

    return rows.select(*columns, "x").mapInArrow(run, schema)


def identity_error(white: DataFrame, k: int) -> float | None:
    """Largest absolute entry of the covariance of ``whitened`` minus the identity, over components with variance."""
    z = [F.col("whitened")[i] for i in range(k)]
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    got = white.agg(*(F.covar_pop(z[i], z[j]).alias(f"c{i}_{j}") for i, j in pairs)).first() if pairs else []
    found = [abs(c - (i == j)) for (i, j), c in zip(pairs, got) if c is not None]
    return max(found, default=None)


def whiten(df: DataFrame, vector: str = "embedding", k: int = COMPONENTS, id_col: str = "vec_id") -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error), a row for each vector and component."""
    rows = integers(df.select(id_col, vector), vector).select(id_col, "x")
    model, each = fit(rows)
    k = min(k, len(model.values))
    error = identity_error(project(each, model, k), k)
    share = [float(e / model.trace) if model.trace else None for e in model.values[:k]]
    out = project(rows, model, k).select(id_col, "deviation", F.posexplode("whitened").alias("at", "whitened"))
    explained = F.array(*(F.lit(s).cast("double") for s in share)) if share else F.array().cast("array<double>")
    return out.select(id_col, (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", F.get(explained, F.col("at")).alias("explained"), F.lit(error).cast("double").alias("identity_error"))
