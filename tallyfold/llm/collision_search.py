"""Nearest neighbours by collision-counting hashing, for the largest inner product.

Vectors are lifted to one length (a last component makes all norms of a block equal), so that the largest inner
product is the smallest distance. Each of ``PROJECTIONS`` hash functions is one random projection; its hash table is
the array of projected values in order, cut into ``BUCKETS`` base buckets of equally many vectors. A query centres a
window of whole base buckets at its own projection in every array, and virtual rehashing widens all windows by the
factor ``GROWTH``. A vector that falls into the windows of at least ``THRESHOLD`` of the arrays is a candidate.
Candidates are verified, those with the most collisions first: their inner product is computed in double precision
on the original vectors. A query stops when ``k`` candidates lie within the distance that the present radius stands
for, or when there are ``BUDGET`` candidates of the block (20 times k at least); windows as wide as the arrays end it
too, so that a query with few candidates finds them all. The budget does not grow with the table.

Every vector is indexed. Vectors are dealt into levels of like norms (a level spans the factor sqrt 2), and a level
into blocks of about ``BLOCK`` rows by a hash of the row number; each block has its own arrays. Queries, the stated set, are sent to
every block in groups of ``QUERY_GROUP``, and the best k of each block are merged by query. No block grows with the
table. Counting costs a byte operation for each projection, vector and query: the number of queries times that of
vectors, since no part of an evenly spread table can be ruled out for a query at a recall of 0.9.

Cases: null vectors, those of norm 0, and those with null, NaN or infinite components take no part, neither do
those of another length than the most frequent one; ties in score go to the smaller id; repeated vectors are
found each; rows that repeat an id are candidates each, for each other too, and as queries have k rows each; fewer
than k candidates are all returned; an empty table gives no rows; rows with a null id take no part; extra columns
are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyfold.llm.common import settle

PROJECTIONS, THRESHOLD = 128, 84
BUCKETS = 256
#: Half a window is at first this share of the block's norm, and grows by this factor.
START, GROWTH = 0.75, 1.5
BUDGET = 600
#: A query may stop early when its k-th distance is under the half window over this.
DEVIATIONS = 1.5
BLOCK, QUERY_GROUP = 8192, 2048
#: Levels of norms; the last one holds all smaller norms.
LEVELS = 24
SEED = 5


def usable(vectors: DataFrame, id_col: str = "vec_id", col: str = "embedding") -> DataFrame:
    """(vec_id, v) of the rows that take part; v is an array of doubles."""
    v = F.col(col).cast("array<double>")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and v is not null").where(~bad)
    return rows.where(F.exists("v", lambda x: x != 0))


class Arrays:
    """The sorted arrays of one block and, for each vector, its base bucket in each of them."""

    def __init__(self, x: np.ndarray, top: float, seed: int = SEED):
        n, dim = x.shape
        self.top, self.n = top, n
        axes = np.random.default_rng(seed).standard_normal((dim + 1, PROJECTIONS))
        lift = np.sqrt(np.maximum(top * top - (x * x).sum(1), 0))
        table = (x @ axes[:dim] + lift[:, None] * axes[dim]).T
        order = np.argsort(table, axis=1, kind="stable")
        self.axes, self.sorted = axes[:dim], np.take_along_axis(table, order, axis=1)
        # the bucket of each place in an array
        self.bucket_of = (np.arange(n) * BUCKETS // n if n > BUCKETS else np.arange(n)).astype(np.uint8)
        self.bucket = np.empty((PROJECTIONS, n), np.uint8)
        np.put_along_axis(self.bucket, order, np.broadcast_to(self.bucket_of, (PROJECTIONS, n)), axis=1)
        self._moved, self._inside = np.empty_like(self.bucket), np.empty(self.bucket.shape, bool)

    def windows(self, centre: np.ndarray, half: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first bucket, last bucket, empty) of each window, by query and projection; ``centre`` has a row per query."""
        first, last = np.empty(centre.shape, np.int64), np.empty(centre.shape, np.int64)
        for p in range(PROJECTIONS):
            first[:, p] = np.searchsorted(self.sorted[p], centre[:, p] - half, "left")
            last[:, p] = np.searchsorted(self.sorted[p], centre[:, p] + half, "right") - 1
        return self.bucket_of[np.minimum(first, self.n - 1)], self.bucket_of[np.maximum(last, 0)], last < first

    def collisions(self, first: np.ndarray, last: np.ndarray, empty: np.ndarray) -> np.ndarray:
        """In how many windows of a query each vector lies."""
        np.subtract(self.bucket, first[:, None], out=self._moved)
        np.less_equal(self._moved, (last - first)[:, None], out=self._inside)
        self._inside[empty] = False
        return np.add.reduce(self._inside.view(np.uint8), axis=0, dtype=np.uint8)


def nearest(q: np.ndarray, q_row: np.ndarray, x: np.ndarray, row: np.ndarray, ids: np.ndarray, k: int, top: float, seed: int = SEED) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of the query, number of the vector, score) of the best k of one block; ``top`` is the block's largest norm."""
    tables = Arrays(x, top, seed)
    # a query is given the full norm, so that its last component is 0
    q_norm = np.sqrt((q * q).sum(1))
    centre = (q * (top / q_norm)[:, None]) @ tables.axes
    enough = max(20 * k, BUDGET)
    out: list[list[np.ndarray]] = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]]
    active, half = np.arange(len(q)), max(START * top, 1e-300)
    while len(active):
        first, last, empty = tables.windows(centre[active], half)
        whole = ((first == 0) & (last == tables.bucket_of[-1]) & ~empty).all(1)
        going = []
        for j, f, to, none, all_in in zip(active.tolist(), first, last, empty, whole.tolist()):
            count = tables.collisions(f, to, none)
            found = np.flatnonzero(count >= THRESHOLD)
            done = all_in or len(found) >= enough
            if len(found) > enough:
                # the most collisions first; those that tie with the last one too
                reach = np.cumsum(np.bincount(count[found], minlength=PROJECTIONS + 1)[::-1])[::-1]
                found = found[count[found] >= np.flatnonzero(reach >= enough)[-1]]
            if not done and len(found) <= k:
                going.append(j)
                continue
            score = x[found] @ q[j]
            if not done:
                # projections of two vectors differ by a normal deviate times their distance
                worst = np.partition(score, -k - 1)[-k - 1] * top / q_norm[j]
                if np.sqrt(max(2 * top * top - 2 * worst, 0)) > half / DEVIATIONS:
                    going.append(j)
                    continue
            found, score = found[row[found] != q_row[j]], score[row[found] != q_row[j]]
            if len(found) > k:
                # the order of the best is that of sums whose rounding does not depend on the other rows
                least = np.partition(score, -k)[-k]
                found = found[score >= least - 1e-9 * max(1.0, abs(least))]
            score = (x[found] * q[j]).sum(1)
            best = np.lexsort((ids[found], -score))[:k]
            out[0].append(np.full(len(best), j))
            out[1].append(found[best])
            out[2].append(score[best])
        active, half = np.array(going, np.int64), half * GROWTH
    return tuple(np.concatenate(c) for c in out)


def search(vectors: DataFrame, k: int = 20, query_every: int = 20, id_col: str = "vec_id", col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id is divisible by ``query_every``, its k nearest found."""
    numbered = usable(vectors, id_col, col).withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, c: s + c * c))).withColumn("row", F.monotonically_increasing_id())
    rows = settle(numbered, "search-rows")
    facts = rows.groupBy(F.size("v").alias("dim")).agg(F.count(F.lit(1)).alias("n"), F.max("norm").alias("top"), F.count_if(F.col("vec_id") % query_every == 0).alias("q")).orderBy(F.desc("n"), "dim").first()
    dim, top, n_q = (facts["dim"], facts["top"], facts["q"]) if facts else (1, 1.0, 0)
    level = F.least(F.floor(2 * F.log2(F.lit(top) / F.col("norm"))), F.lit(LEVELS - 1)).cast("int")
    rows = rows.where(F.size("v") == dim).withColumn("level", F.greatest(level, F.lit(0)))
    # at most LEVELS rows
    sizes = {r["level"]: r["n"] for r in rows.groupBy("level").agg(F.count(F.lit(1)).alias("n")).collect()}
    parts = [-(-sizes.get(at, 0) // BLOCK) for at in range(LEVELS)]
    blocks, groups = max(1, sum(parts)), max(1, -(-n_q // QUERY_GROUP))
    before = F.array(*(F.lit(sum(parts[:at])) for at in range(LEVELS)))
    deal = lambda by, of: F.pmod(F.xxhash64(F.lit(by), "row"), of).cast("int")
    block = before[F.col("level")] + deal(1, F.array(*(F.lit(max(1, p)) for p in parts))[F.col("level")])
    indexed = rows.select(F.col("row").alias("at"), F.col("vec_id").alias("id"), F.col("v").alias("x"), "norm", block.alias("block"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("part"))
    asked = rows.where(F.col("vec_id") % query_every == 0).select("row", "vec_id", "v", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), deal(2, F.lit(groups)).alias("part"))

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_row": [], "query_id": [], "vec_id": [], "score": []})
        left, right = left.sort_values("vec_id", kind="stable"), right.sort_values("id", kind="stable")
        q_row, row, ids = left["row"].to_numpy(np.int64), right["at"].to_numpy(np.int64), right["id"].to_numpy(np.int64)
        j, i, score = nearest(np.stack(left["v"].to_list()), q_row, np.stack(right["x"].to_list()), row, ids, k, float(right["norm"].max()))
        return pd.DataFrame({"query_row": q_row[j], "query_id": left["vec_id"].to_numpy(np.int64)[j], "vec_id": ids[i], "score": score})

    found = asked.groupBy("block", "part").cogroup(indexed.groupBy("block", "part")).applyInPandas(run, "query_row long, query_id long, vec_id long, score double")
    best = F.row_number().over(W.partitionBy("query_row").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", best).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
