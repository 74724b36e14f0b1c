"""Making forecasts of leaves, services and total add up. Rows carry (keys, series_id, level, service, y_pred, lo, hi)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

VALUES = ["y_pred", "lo", "hi"]


def _leaf_sums(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Aggregates replaced by sums of the leaves, bounds too."""
    leaves = rows.where("level = 'leaf'")
    sums = [F.sum(v).alias(f"__{v}") for v in VALUES]
    by_service = leaves.groupBy(*keys, "service").agg(*sums).withColumn("level", F.lit("service"))
    total = leaves.groupBy(*keys).agg(*sums).withColumns({"level": F.lit("total"), "service": F.lit(None).cast("int")})
    new = by_service.unionByName(total).withColumnRenamed("service", "__s").withColumnRenamed("level", "__l")
    out = rows.where("level <> 'leaf'").join(new.select(*(F.col(k).alias(f"__k_{k}") for k in keys), "__s", "__l", *(f"__{v}" for v in VALUES)), [F.col(k) == F.col(f"__k_{k}") for k in keys] + [F.col("level") == F.col("__l"), F.col("service").eqNullSafe(F.col("__s"))])
    out = out.withColumns({v: F.col(f"__{v}") for v in VALUES}).select(*rows.columns)
    return leaves.unionByName(out)


def bottom_up(rows: DataFrame, keys: list[str]) -> DataFrame:
    return _leaf_sums(rows, keys)


def _scaled(rows: DataFrame, keys: list[str], level: str, group: list[str]) -> DataFrame:
    """Leaves scaled to the aggregate of ``level``; the factor is 1 where their sum is 0."""
    w = W.partitionBy(*keys, *group)
    mine = rows.where(F.col("level").isin("leaf", level))
    target = F.max(F.when(F.col("level") == level, F.col("y_pred"))).over(w)
    own = F.sum(F.when(F.col("level") == "leaf", F.col("y_pred"))).over(w)
    factor = F.when(own > 0, target / own).otherwise(1.0)
    return mine.withColumn("__f", factor).where("level = 'leaf'").withColumns({v: F.col(v) * F.col("__f") for v in VALUES}).drop("__f")


def top_down(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The total stays; leaves are scaled to it and services are their sums."""
    scaled = _leaf_sums(_scaled(rows, keys, "total", []).unionByName(rows.where("level <> 'leaf'")), keys)
    return scaled.where("level <> 'total'").unionByName(rows.where("level = 'total'"))


def middle_out(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Services stay; leaves are scaled to them and the total is their sum."""
    services = rows.where("level = 'service'")
    sums = services.groupBy(*keys).agg(*(F.sum(v).alias(f"__{v}") for v in VALUES))
    total = rows.where("level = 'total'").join(sums, keys).withColumns({v: F.col(f"__{v}") for v in VALUES}).select(*rows.columns)
    return _scaled(rows, keys, "service", ["service"]).unionByName(services).unionByName(total)


def structural(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Weighted least squares with the number of leaves as weights, in closed form.

    ``leaf + (V_s - L_s) / (2 n_s) + (2 R - L - V) / (6 m)`` with leaf sums L, services V, total R; then clipped at
    0 and added up again. Bounds move with their point.
    """
    w, s = W.partitionBy(*keys), W.partitionBy(*keys, "service")
    pick = lambda level: F.when(F.col("level") == level, F.col("y_pred"))
    stats = {"__Ls": F.sum(pick("leaf")).over(s), "__Vs": F.max(pick("service")).over(s), "__ns": F.count(pick("leaf")).over(s), "__L": F.sum(pick("leaf")).over(w), "__V": F.sum(pick("service")).over(w), "__R": F.max(pick("total")).over(w), "__m": F.count(pick("leaf")).over(w)}
    at = rows.withColumns(stats)
    moved = F.col("y_pred") + (F.col("__Vs") - F.col("__Ls")) / (2 * F.col("__ns")) + (2 * F.col("__R") - F.col("__L") - F.col("__V")) / (6 * F.col("__m"))
    leaves = at.where("level = 'leaf'").withColumn("__new", F.greatest(moved, F.lit(0.0))).select(*rows.columns, "__new")
    by_service = leaves.groupBy(*keys, F.col("service").alias("__s")).agg(F.sum("__new").alias("__new")).withColumn("__l", F.lit("service"))
    total = leaves.groupBy(*keys).agg(F.sum("__new").alias("__new")).withColumns({"__l": F.lit("total"), "__s": F.lit(None).cast("int")})
    sums = by_service.unionByName(total).select(*(F.col(k).alias(f"__k_{k}") for k in keys), "__s", "__l", "__new")
    upper = rows.where("level <> 'leaf'").join(sums, [F.col(k) == F.col(f"__k_{k}") for k in keys] + [F.col("level") == F.col("__l"), F.col("service").eqNullSafe(F.col("__s"))]).select(*rows.columns, "__new")
    every = leaves.unionByName(upper)
    shift = F.col("__new") - F.col("y_pred")
    lo = F.greatest(F.col("lo") + shift, F.lit(0.0))
    return every.withColumns({"lo": lo, "hi": F.greatest(F.col("hi") + shift, lo)}).withColumn("y_pred", F.col("__new")).select(*rows.columns)


def coherence_gap(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, total, leaves, gap, gap_percent)."""
    total, leaves = F.max(F.when(F.col("level") == "total", F.col("y_pred"))), F.sum(F.when(F.col("level") == "leaf", F.col("y_pred")))
    out = rows.groupBy(*keys).agg(total.alias("total"), leaves.alias("leaves"))
    return out.withColumn("gap", F.col("total") - F.col("leaves")).withColumn("gap_percent", F.when(F.col("total") != 0, 100 * F.abs("gap") / F.col("total")))
