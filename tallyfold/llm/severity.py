"""Toxicity severity by cumulative-link ordinal regression on sparse text features.

``P(grade <= k) = sigmoid(theta_k - w.x)`` for ordered thresholds theta_0 < theta_1 that share the weights w;
the result is the expected grade, ``sum_k P(grade > k)``. Features are the presence of hashed lower-case words
and of their first four letters, so that inflected forms share evidence. Grades for training come from the
label table: 0 for not toxic, else 1, or 2 where the share of words that mark toxic texts is high.

The model is fitted on the driver, on at most ``SAMPLE`` labelled rows (those with the smallest hash of their
id, so that any number of executors picks the same rows); everything else, scoring included, is distributed.
Only the ``FEATURES`` hashed weights and the thresholds go to the executors.

Cases: null and empty texts have no features and get the grade of the intercept, near 0; texts of any length are read
whole; of documents that repeat an id the least text is fitted, once, and each is scored; labels that are null are
left out of the fit; without a toxic and a clean label the model scores everything 0; equal texts get equal
scores; an empty table of documents gives no rows, one of labels a model that scores 0; extra columns are kept by ``score_column`` and ``keep_clean``, which replace a column named as their output.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FEATURES = 1 << 18
#: Labelled rows used at most by the fit.
SAMPLE = 8_000
RIDGE = 1e-5
STEPS = 120
MEMO_SIZE, MEMO_WORD = 300_000, 40
REJECT = 0.5
_WORD = re.compile(r"[^\W\d_]+")


class Features(dict):
    """Word to the numbers of its features; short words are remembered."""

    def __missing__(self, word: str) -> tuple[int, int]:
        got = (xxhash.xxh32_intdigest(word) % FEATURES, xxhash.xxh32_intdigest("^" + word[:4]) % FEATURES)
        if len(word) <= MEMO_WORD:
            if len(self) >= MEMO_SIZE:
                self.clear()
            self[word] = got
        return got


def features(text: str | None, memo: Features) -> set[int]:
    """The distinct features of a text."""
    out: set[int] = set()
    if text:
        for pair in map(memo.__getitem__, set(_WORD.findall(text.lower()))):
            out.update(pair)
    return out


def _sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))


class OrdinalModel:
    """Shared weights and ordered thresholds."""

    def __init__(self, weights: np.ndarray, thresholds: np.ndarray):
        self.weights, self.thresholds = weights, thresholds

    def expected(self, z: np.ndarray) -> np.ndarray:
        return sum(_sigmoid(z - t) for t in self.thresholds)


def _seen(rows: list[np.ndarray], positive: np.ndarray) -> np.ndarray:
    """How many other and how many positive rows hold each feature."""
    return np.array([np.bincount(np.concatenate([np.zeros(0, np.int32), *(r for r, y in zip(rows, positive) if y == k)]), minlength=FEATURES) for k in (False, True)])


def evidence(rows: list[np.ndarray], positive: np.ndarray) -> np.ndarray:
    """Scale of each feature: its log odds ratio between positive and other rows, drawn to 0 by two standard errors."""
    seen = _seen(rows, positive)
    n = np.array([(~positive).sum(), positive.sum()])
    a, b = seen[1] + 0.25, seen[0] + 0.25
    a_not, b_not = n[1] - seen[1] + 0.25, n[0] - seen[0] + 0.25
    ratio = np.log(a * b_not / (b * a_not))
    error = np.sqrt(1 / a + 1 / b + 1 / a_not + 1 / b_not)
    return np.sign(ratio) * np.maximum(0, np.abs(ratio) - 2 * error)


def objective(w: np.ndarray, theta: np.ndarray, row: np.ndarray, column: np.ndarray, size: np.ndarray, grades: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Penalised mean of -log P(grade), and its gradients by ``w`` and ``theta``.

    Row ``row[i]`` has the feature ``column[i]`` with the value ``size[i]``. ``theta`` is the first threshold and the
    logarithms of the gaps to the next ones, so that thresholds stay in order.
    """
    n, cuts = len(grades), len(theta)
    z = np.bincount(row, w[column] * size, n)
    cut = np.concatenate([theta[:1], theta[0] + np.cumsum(np.exp(theta[1:]))])
    at = _sigmoid(cut[None, :] - z[:, None])
    full = np.concatenate([np.zeros((n, 1)), at, np.ones((n, 1))], 1)
    p = np.maximum(full[np.arange(n), grades + 1] - full[np.arange(n), grades], 1e-9)
    slope = at * (1 - at)
    lower = np.arange(cuts)
    by_cut = -((grades[:, None] == lower) * slope - (grades[:, None] == lower + 1) * slope) / p[:, None]
    g_w = np.bincount(column, -by_cut.sum(1)[row] * size, len(w)) / n + RIDGE * w
    by_cut = by_cut.sum(0) / n
    g_t = np.concatenate([[by_cut.sum()], [np.exp(theta[k]) * by_cut[k:].sum() for k in range(1, cuts)]])
    return float(-np.log(p).mean() + RIDGE * (w * w).sum() / 2), g_w, g_t


def fit(rows: list[np.ndarray], grades: np.ndarray, n_grades: int = 3) -> OrdinalModel:
    """Ridge-penalised likelihood by Adam over all rows at once; features are scaled by their ``evidence``."""
    scale = evidence(rows, grades > 0)
    flat = np.concatenate(rows)
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    keep = scale[flat] != 0
    row = row[keep]
    names, column = np.unique(flat[keep], return_inverse=True)
    size = scale[names][column]
    w = np.zeros(len(names))
    share = np.array([(grades > k).mean() for k in range(n_grades - 1)]).clip(1e-4, 1 - 1e-4)
    first = np.log((1 - share[0]) / share[0])
    gaps = np.log(np.maximum(np.diff(np.log((1 - share) / share)), 0.1))
    theta = np.concatenate([[first], gaps])
    m = [np.zeros_like(w), np.zeros_like(theta)]
    v = [np.zeros_like(w), np.zeros_like(theta)]
    for step in range(1, STEPS + 1):
        _, g_w, g_t = objective(w, theta, row, column, size, grades)
        for i, (x, g) in enumerate(((w, g_w), (theta, g_t))):
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.999 * v[i] + 0.001 * g * g
            x -= 0.1 * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    weights = np.zeros(FEATURES)
    weights[names] = w * scale[names]
    return OrdinalModel(weights, np.concatenate([theta[:1], theta[0] + np.cumsum(np.exp(theta[1:]))]))


def graded(rows: list[np.ndarray], toxic: np.ndarray) -> np.ndarray:
    """Grades 0, 1, 2 of labelled rows: 2 for toxic rows with over the median number of marking features."""
    n = np.maximum(np.array([(toxic == k).sum() for k in (0, 1)]), 1)
    seen = _seen(rows, toxic == 1)
    marks = (seen[1] >= 5) & (seen[1] / n[1] > 5 * (seen[0] + 0.5) / n[0])
    hits = np.array([marks[r].sum() for r in rows])
    middle = np.median(hits[toxic == 1]) if (toxic == 1).any() else 0
    return np.where(toxic == 0, 0, np.where(hits > middle, 2, 1))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> OrdinalModel:
    """Fits on the rows of ``labels`` with known ``toxic``; at most ``sample`` of them."""
    chosen = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    # as bytes, which take a tenth of the driver's memory that lists do
    @F.pandas_udf("binary")
    def hashed(texts: pd.Series) -> pd.Series:
        memo = Features()
        return pd.Series([np.array(sorted(features(t, memo)), np.int32).tobytes() for t in texts])

    # at most ``sample`` rows, so this side has a bound; one text for each id, so that the result has it too
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    rows = texts.select("doc_id", "toxic", hashed("text").alias("f"))
    # ties in the order of arrival would change the last digits of the fit
    got = rows.toPandas().sort_values("doc_id", kind="stable")
    sets, y = [np.frombuffer(bytes(f), np.int32) for f in got["f"]], got["toxic"].to_numpy(np.int64)
    if not len(y) or y.min() == y.max():
        return OrdinalModel(np.zeros(FEATURES), np.array([35.0, 36.0]))
    return fit(sets, graded(sets, y))


def score_column(docs: DataFrame, model: OrdinalModel, col: str = "text", out: str = "severity") -> DataFrame:
    """``docs`` with the expected grade (0 to 2) of ``col`` in ``out``."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((model.weights.astype(np.float32), model.thresholds))

    @F.pandas_udf("double")
    def severity(texts: pd.Series) -> pd.Series:
        weights, thresholds = shared.value
        memo = _memo
        z = np.array([float(weights[np.fromiter(f, np.int64, len(f))].sum()) if (f := features(t, memo)) else 0.0 for t in texts])
        return pd.Series(OrdinalModel(weights, thresholds).expected(z))

    return docs.withColumn(out, severity(F.col(col)))


_memo = Features()


def keep_clean(docs: DataFrame, model: OrdinalModel, reject: float = REJECT) -> DataFrame:
    """The rows whose expected grade stays below ``reject``, with the columns of ``docs``."""
    columns = docs.columns
    return score_column(docs, model, out="__severity").where(F.col("__severity") < reject).select(*columns)
