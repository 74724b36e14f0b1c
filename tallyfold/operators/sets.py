"""Set operations, first and last rows, ordered top and bottom."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def parts(*frames: DataFrame) -> DataFrame:
    """All rows; columns that a part lacks are null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def differences(actual: DataFrame, official: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, difference): keys that are missing and keys that are extra."""
    a, b = actual.select(*keys).distinct(), official.select(*keys).distinct()
    return b.subtract(a).withColumn("difference", F.lit("missing")).union(a.subtract(b).withColumn("difference", F.lit("extra")))


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return df.withColumn("__r", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("__r = 1").drop("__r")


def top_and_bottom(df: DataFrame, value: str, tie: str, k: int) -> DataFrame:
    """The k highest and the k lowest rows, nulls last, with ``side``."""
    high = df.orderBy(F.desc_nulls_last(value), tie).limit(k).withColumn("side", F.lit("top"))
    return high.unionByName(df.orderBy(F.asc_nulls_last(value), tie).limit(k).withColumn("side", F.lit("bottom")))
