"""Ranks and running sums over a whole table, in two steps, so that no task holds it.

Rows are dealt to ranges of the order, sums are taken by range, and each range starts where those before it end. A
window without a partition sees one row per range only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyfold.sources import shared


def running(df: DataFrame, order: list[Column], sums: dict[str, Column] | None = None, rank: str | None = None) -> DataFrame:
    """``df`` with ``rank``, a number from 1 in the order, and running sums up to and with each row.

    ``order`` has to be a full one, or equal rows are numbered at random. The ranges are written, as a range is known
    by its files alone: another run of the same plan may cut them elsewhere.
    """
    sums = sums or {}
    cells = {f"__v{k}": v for k, v in enumerate(sums.values())}
    dealt = shared.kept(df.withColumns(cells).repartitionByRange(*order).withColumn("__range", F.spark_partition_id()), "ranges")
    inside = W.partitionBy("__range").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    totals = dealt.groupBy("__range").agg(F.count(F.lit(1)).alias("__n"), *(F.sum(c).alias(f"__s{c}") for c in cells))
    # one row per range
    before = W.orderBy("__range").rowsBetween(W.unboundedPreceding, -1)
    start = totals.select("__range", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"__b{c}") for c in ("__n", *(f"__s{c}" for c in cells))))
    rows = dealt.join(F.broadcast(start), "__range")
    if rank:
        rows = rows.withColumn(rank, (F.col("__b__n") + F.row_number().over(inside)).cast("int"))
    for name, c in zip(sums, cells):
        rows = rows.withColumn(name, F.col(f"__b__s{c}") + F.coalesce(F.sum(c).over(inside), F.lit(0)))
    return rows.drop("__range", *cells, "__b__n", *(f"__b__s{c}" for c in cells))
