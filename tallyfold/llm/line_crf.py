"""Document quality by a linear-chain conditional random field over lines.

Each line is good or bad. ``log P(labels)`` is the sum over lines of what the line's features and those of the lines
before and after it say for "good", and of a weight for each pair of neighbouring labels and for the first label. The
features are ``KINDS`` small codes a line: length, words, distinct words, words that repeat the word before, symbols, exclamation marks, capitals, digits,
mean length of words, first and last character, sentence ends, and whether a line repeats a neighbour or an earlier one.
Forward and backward sums give the probability of "good" for each line; the score of a document is their mean,
weighted by the lines' lengths.

Only documents are labelled, so all lines of a labelled document carry its label in the fit; lines that occur in both
kinds of documents are told by their neighbours. The fit is on the driver, on at most ``SAMPLE`` labelled documents
(those with the smallest hash of their id) of at most ``FIT_LINES`` lines, of which ``KINDS`` bytes a line come there. All
else, scoring included, is distributed, and only the weights go to the executors.

Cases: null and empty texts are one empty line, which has a score like any other; texts of any length are read whole,
a slice of about ``SLICE`` bytes of lines at a time, one longer text alone; labels that are null are left out of the fit,
the greater of repeated labels counts, and of documents that repeat an id the least text is fitted, once, while each is
scored; without a good and a bad label every score is the share of good labels (1 without any); equal texts have equal
scores; rows without an id are not held out; extra columns pass through, and a column named as the output is replaced.
"""

from __future__ import annotations

import operator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Documents, and lines of each, that the fit uses at most.
SAMPLE, FIT_LINES = 8_000, 1_000
SLICE = 1 << 20
KINDS, CODES = 13, 16
NONE = CODES - 1
RIDGE, STEPS, RATE = 1e-4, 150, 0.15
ACCEPT = 0.3
HELD_OUT = 5
_SYMBOLS = b"#$%&*|<>{}[]\\^~_=+@/`"
_CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_DIGITS = b"0123456789"
_CUTS = (0.0, 0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.7, 0.9, 1.2, 2.0, 3.0)


def _share(part: int, whole: int) -> int:
    x = part / whole if whole else 0.0
    return sum(x > c for c in _CUTS)


def _kind(byte: int) -> int:
    """Group of a character by its first or last byte."""
    if byte > 127:
        return 1
    char = bytes((byte,))
    for at, group in enumerate((b".", b",", b"!", b"?", b":;", b"|", _DIGITS, _CAPITALS, _SYMBOLS), 2):
        if char in group:
            return at
    return 11 if char.isalpha() else 12


_KINDS = [_kind(b) for b in range(256)]


def codes(line: bytes, before: bytes | None, after: bytes | None, repeats: bool) -> tuple[int, ...]:
    """The codes of a line, each under ``NONE``."""
    words = line.split()
    n, m = len(line), len(words)
    left = line.strip()
    return (
        min(n.bit_length(), 14), min(m.bit_length(), 14), 0 if m < 4 else 1 + int(10 * len(set(words)) / m), _share(sum(map(operator.eq, words, words[1:])), m),
        _share(n - len(line.translate(None, _SYMBOLS)), m), _share(line.count(b"!"), m), _share(n - len(line.translate(None, _CAPITALS)), n), _share(n - len(line.translate(None, _DIGITS)), n),
        min(n // m, 14) if m else 0, _KINDS[left[0]] if left else 0, _KINDS[left[-1]] if left else 0, _share(line.count(b"."), m),
        1 * (line == before or line == after) + 2 * repeats,
    )


class Lines(NamedTuple):
    """The lines of some documents, one after the other."""

    codes: np.ndarray
    length: np.ndarray
    #: Number of lines of each document.
    counts: np.ndarray


def lines_of(texts: list[str]) -> Lines:
    found, length, counts = [], [], []
    for text in texts:
        rows = text.encode("utf-8", "surrogatepass").split(b"\n")
        seen: set[bytes] = set()
        for at, line in enumerate(rows):
            found.append(codes(line, rows[at - 1] if at else None, rows[at + 1] if at + 1 < len(rows) else None, line in seen))
            seen.add(line)
            length.append(len(line) + 1)
        counts.append(len(rows))
    return Lines(np.array(found, np.uint8).reshape(-1, KINDS), np.array(length, np.int64), np.array(counts, np.int64))


def indices(lines: Lines) -> np.ndarray:
    """For each line the places of its weights: its own codes, those of the line before and of the line after."""
    own = lines.codes.astype(np.int32)
    first = np.cumsum(lines.counts) - lines.counts
    before, after = np.roll(own, 1, 0), np.roll(own, -1, 0)
    before[first], after[first + lines.counts - 1] = NONE, NONE
    return np.concatenate([own, before, after], 1) + np.arange(3 * KINDS, dtype=np.int32) * CODES


class Chain(NamedTuple):
    """The order in which documents are run through: all first lines, all second lines, and so on.

    Documents stand by falling number of lines, so that those that have a line at a place are the first ones.
    """

    #: Line at each place of the order, and the number of documents at each step.
    at: np.ndarray
    width: np.ndarray


def chain(counts: np.ndarray) -> Chain:
    order = np.argsort(-counts, kind="stable")
    first = (np.cumsum(counts) - counts)[order]
    place = np.arange(counts.sum()) - np.repeat(np.cumsum(counts[order]) - counts[order], counts[order])
    by_place = np.argsort(place, kind="stable")
    return Chain((np.repeat(first, counts[order]) + place)[by_place], np.bincount(place) if len(place) else np.zeros(0, np.int64))


class Model(NamedTuple):
    weights: np.ndarray
    #: Of the label before (bad, good) and the label (bad, good).
    pairs: np.ndarray
    #: Of a first line that is bad, good.
    start: np.ndarray


def marginals(scores: np.ndarray, order: Chain, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(P(good) by line, sums of P(label before, label), sums of P(first label), log of the sum over all labels).

    Forward and backward sums, each step for all documents that are long enough; sums of each step are scaled to 1. The
    middle two are summed over documents, the last one is by document in the order of ``order``.
    """
    s = scores[order.at]
    up = np.exp(np.stack([np.minimum(-s, 0), np.minimum(s, 0)], 1))
    lift = np.maximum(s, 0)
    e = np.exp(model.pairs)
    ends = np.cumsum(order.width)
    begins = ends - order.width
    forward, norm = np.empty_like(up), np.empty(len(s))
    for k, (a, b) in enumerate(zip(begins, ends)):
        now = (np.exp(model.start) if k == 0 else forward[begins[k - 1] : begins[k - 1] + b - a] @ e) * up[a:b]
        norm[a:b] = now.sum(1)
        forward[a:b] = now / norm[a:b, None]
    good, backward = np.empty(len(s)), np.ones((0, 2))
    joint, first = np.zeros((2, 2)), np.zeros(2)
    for k in range(len(begins) - 1, -1, -1):
        a, b = begins[k], ends[k]
        # documents that end here have nothing after them
        behind = np.ones((b - a, 2))
        behind[: len(backward)] = backward
        good[a:b] = forward[a:b, 1] * behind[:, 1] / (forward[a:b] * behind).sum(1)
        carry = up[a:b] * behind / norm[a:b, None]
        if k:
            joint += e * (forward[begins[k - 1] : begins[k - 1] + b - a].T @ carry)
            backward = carry @ e.T
        else:
            first = np.stack([1 - good[a:b], good[a:b]]).sum(1)
    out = np.empty(len(s))
    out[order.at] = good
    total = np.zeros(order.width[0] if len(order.width) else 0)
    for a, b in zip(begins, ends):
        total[: b - a] += np.log(norm[a:b]) + lift[a:b]
    return out, joint, first, total


def objective(model: Model, index: np.ndarray, counts: np.ndarray, order: Chain, good: np.ndarray) -> tuple[float, Model]:
    """Penalised mean over documents of -log P(all lines have the document's label), and its gradient."""
    n = len(counts)
    scores = model.weights[index].sum(1)
    p, joint, first, total = marginals(scores, order, model)
    of_line = np.repeat(good, counts).astype(np.float64)
    longer = counts - 1
    seen_pairs = np.diag([longer[good == 0].sum(), longer[good == 1].sum()]).astype(np.float64)
    seen_start = np.array([(good == 0).sum(), (good == 1).sum()], np.float64)
    # a bad line adds 0, a good one its score
    seen = (scores * of_line).sum() + (seen_pairs * model.pairs).sum() + (seen_start * model.start).sum()
    g_w = np.bincount(index.ravel(), np.repeat(p - of_line, index.shape[1]), len(model.weights))
    penalty = sum((x * x).sum() for x in model)
    return float((total.sum() - seen) / n + RIDGE / 2 * penalty), Model(g_w / n + RIDGE * model.weights, (joint - seen_pairs) / n + RIDGE * model.pairs, (first - seen_start) / n + RIDGE * model.start)


def fit(lines: Lines, good: np.ndarray) -> Model:
    """Weights by Adam over all documents at once, whose steps shrink to 0."""
    index, order = indices(lines), chain(lines.counts)
    model = Model(np.zeros(3 * KINDS * CODES), np.zeros((2, 2)), np.zeros(2))
    m, v = ([np.zeros_like(x) for x in model] for _ in range(2))
    for step in range(1, STEPS + 1):
        _, g = objective(model, index, lines.counts, order, good)
        for k, (x, d) in enumerate(zip(model, g)):
            m[k] = 0.9 * m[k] + 0.1 * d
            v[k] = 0.99 * v[k] + 0.01 * d * d
            x -= RATE * (1 - step / (STEPS + 1)) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
    return model


def constant(share: float) -> Model:
    """Every line is good with the same chance."""
    share = min(max(share, 1e-6), 1 - 1e-6)
    return Model(np.zeros(3 * KINDS * CODES), np.array([[35.0, -35.0], [-35.0, 35.0]]), np.log(np.array([1 - share, share])))


def scores(texts: list[str], model: Model) -> np.ndarray:
    """Mean probability of good lines, weighted by their lengths."""
    lines = lines_of(texts)
    if not len(lines.counts):
        return np.zeros(0)
    p = marginals(model.weights[indices(lines)].sum(1), chain(lines.counts), model)[0]
    doc = np.repeat(np.arange(len(lines.counts)), lines.counts)
    return np.clip(np.bincount(doc, p * lines.length, len(lines.counts)) / np.bincount(doc, lines.length, len(lines.counts)), 0, 1)


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from the fit, by its id alone."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % HELD_OUT == 0, F.lit(False))


def _parts(texts: pd.Series):
    """Lists of texts of about ``SLICE`` characters."""
    part, size = [], 0
    for t in texts:
        part.append(t or "")
        size += len(part[-1])
        if size >= SLICE:
            yield part
            part, size = [], 0
    if part:
        yield part


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fits on the labelled documents that are not held out; at most ``sample`` of them."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id")))
    chosen = known.groupBy("doc_id").agg(F.max("quality").alias("good")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    @F.pandas_udf("codes binary, length binary")
    def coded(texts: pd.Series) -> pd.DataFrame:
        found = [lines_of([t]) for t in texts]
        return pd.DataFrame({"codes": [x.codes.tobytes() for x in found], "length": [x.length.tobytes() for x in found]})

    # at most ``sample`` rows, so this side has a bound; one text for each id, so that the result has it too
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "good").agg(F.min("text").alias("text"))
    texts = texts.where(F.length("text") - F.length(F.translate("text", "\n", "")) < FIT_LINES)
    got = texts.select("doc_id", "good", coded("text").alias("lines")).select("doc_id", "good", "lines.codes", "lines.length").toPandas().sort_values("doc_id", kind="stable")
    good = got["good"].to_numpy(np.int64)
    if not len(good) or good.min() == good.max():
        return constant(float(good.mean()) if len(good) else 1.0)
    by_doc = [np.frombuffer(bytes(c), np.uint8).reshape(-1, KINDS) for c in got["codes"]]
    length = np.concatenate([np.frombuffer(bytes(x), np.int64) for x in got["length"]])
    return fit(Lines(np.concatenate(by_doc), length, np.array([len(c) for c in by_doc])), good)


def score_column(docs: DataFrame, model: Model, col: str = "text", out: str = "quality_score") -> DataFrame:
    """``docs`` with the score of ``col`` in ``out``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def quality(texts: pd.Series) -> pd.Series:
        parts = [scores(part, shared.value) for part in _parts(texts)]
        return pd.Series(np.concatenate([np.zeros(0), *parts]))

    return docs.withColumn(out, quality(F.col(col)))
