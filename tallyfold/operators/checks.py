"""Data-contract checks. Each returns the offending rows, so that it runs as one job on a table of any size."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T


def grain(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that are null in a part or occur more than once."""
    null = F.exists(F.array(*(F.col(k).isNull() for k in keys)), lambda x: x)
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where((F.col("n") > 1) | null)


def domain(df: DataFrame, column: str, allowed: DataFrame) -> DataFrame:
    """(value, n) of values that ``allowed`` (value) lacks."""
    found = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    return found.join(allowed, "value", "left_anti")


def bounds(df: DataFrame, column: str, low: float | None, high: float | None) -> DataFrame:
    """Rows outside [low, high]; nulls pass."""
    bad = F.lit(False)
    if low is not None:
        bad = bad | (F.col(column) < low)
    if high is not None:
        bad = bad | (F.col(column) > high)
    return df.where(bad)


def hierarchy(df: DataFrame, whole: str, parts: list[str]) -> DataFrame:
    """Rows whose parts, all known, do not add up to the whole, or one of whose parts is over it."""
    known = F.col(whole).isNotNull()
    for p in parts:
        known = known & F.col(p).isNotNull()
    over = F.exists(F.array(*(F.col(p) > F.col(whole) for p in parts)), lambda x: F.coalesce(x, F.lit(False)))
    return df.where((known & (sum(F.col(p) for p in parts) != F.col(whole))) | over)


def ratio_domain(df: DataFrame, ratio: str, denominator: str) -> DataFrame:
    """Ratios outside [0, 1], and ratios over a denominator of 0 or less."""
    return df.where((F.col(ratio) < 0) | (F.col(ratio) > 1) | ((F.col(denominator) <= 0) & F.col(ratio).isNotNull()))


def reconcile(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, left, right) where the sums of two tables differ or one lacks the key."""
    left = a.groupBy(*keys).agg(F.sum(value).alias("left"))
    right = b.groupBy(*keys).agg(F.sum(value).alias("right"))
    return left.join(right, keys, "full").where(~F.col("left").eqNullSafe(F.col("right")))


def rules(df: DataFrame, key: str, named: dict[str, Column]) -> DataFrame:
    """(key, rule) for each row and rule that does not hold; null does not hold."""
    broken = F.array_compact(F.array(*(F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in named.items())))
    return df.select(key, F.explode(broken).alias("rule"))


def both_or_none(a: str, b: str) -> Column:
    return F.col(a).isNull() == F.col(b).isNull()


def null_iff_silent(reported: Column, measures: list[str]) -> Column:
    """No report means that no measure is set, a report that all are."""
    all_set, none_set = F.lit(True), F.lit(True)
    for m in measures:
        all_set, none_set = all_set & F.col(m).isNotNull(), none_set & F.col(m).isNull()
    return F.when(reported, all_set).otherwise(none_set)


def ascending(*columns: str) -> Column:
    """Values do not fall from one column to the next; nulls pass."""
    out = F.lit(True)
    for a, b in zip(columns, columns[1:]):
        out = out & F.coalesce(F.col(a) <= F.col(b), F.lit(True))
    return out


def published_totals(detail: DataFrame, published: DataFrame, keys: list[str], value: str, tolerance: float = 0.005) -> DataFrame:
    """Published totals that differ from the sum of the detail by more than ``tolerance`` per summed row."""
    own = detail.groupBy(*keys).agg(F.sum(value).alias("detail"), F.count("*").alias("n"))
    both = own.join(published.select(*keys, F.col(value).alias("published")), keys, "full")
    return both.where(F.col("detail").isNull() | F.col("published").isNull() | (F.abs(F.col("detail") - F.col("published")) > tolerance * F.col("n")))


def row_sums(df: DataFrame, whole: str, parts: list[str]) -> DataFrame:
    return df.where(F.col(whole) != sum(F.coalesce(F.col(p), F.lit(0)) for p in parts))


def formula_fit(df: DataFrame, published: str, candidates: dict[str, Column], by: list[str], tolerance: float) -> DataFrame:
    """(by, formula, n, fit): share of rows whose published value each candidate formula gives."""
    tries = F.array(*(F.struct(F.lit(n).alias("formula"), c.cast("double").alias("value")) for n, c in candidates.items()))
    long = df.select(*by, published, F.explode(tries).alias("c")).select(*by, published, "c.*")
    fits = F.abs(F.col("value") - F.col(published)) <= tolerance
    return long.groupBy(*by, "formula").agg(F.count("*").alias("n"), F.avg(F.coalesce(fits, F.lit(False)).cast("double")).alias("fit"))


def regular_grid(df: DataFrame, series: str, period: str) -> DataFrame:
    """Series whose periods are not those of the others."""
    per = df.groupBy(series).agg(F.count("*").alias("n"), F.count_distinct(period).alias("d"), F.min(period).alias("a"), F.max(period).alias("b"))
    every = W.partitionBy()
    all_of = per.withColumns({"most": F.max("n").over(every), "first": F.min("a").over(every), "last": F.max("b").over(every)})
    return all_of.where((F.col("n") != F.col("most")) | (F.col("n") != F.col("d")) | (F.col("a") != F.col("first")) | (F.col("b") != F.col("last"))).select(series, "n", "a", "b")


def not_at_end(df: DataFrame, series: str, period: str, complete: str) -> DataFrame:
    """Incomplete periods that a complete one follows."""
    later = F.max(F.col(complete).cast("int")).over(W.partitionBy(series).orderBy(F.desc(period)).rowsBetween(W.unboundedPreceding, -1))
    return df.withColumn("__later", later).where(~F.col(complete) & (F.col("__later") == 1)).drop("__later")


def repeats(df: DataFrame, unit: str, within: list[str]) -> DataFrame:
    """Units that a source counts twice."""
    return df.groupBy(*within, unit).agg(F.count("*").alias("n")).where("n > 1")


def freshness(manifest: DataFrame, current: DataFrame, key: str = "input", value: str = "fingerprint") -> DataFrame:
    """(input, reason): inputs that changed, appeared or went since the manifest was written."""
    old, new = manifest.select(key, F.col(value).alias("__old")), current.select(key, F.col(value).alias("__new"))
    reason = F.when(F.col("__old").isNull(), "new").when(F.col("__new").isNull(), "gone").when(F.col("__old") != F.col("__new"), "changed")
    return old.join(new, key, "full").select(key, reason.alias("reason")).where("reason is not null")


def misaligned_cutoffs(products: dict[str, DataFrame], year: str = "year", week: str = "week") -> DataFrame:
    """(product, cutoff): last weeks of the products, if they differ."""
    out = None
    for name, df in products.items():
        one = df.agg(F.max(F.col(year) * 100 + F.col(week)).alias("cutoff")).select(F.lit(name).alias("product"), "cutoff")
        out = one if out is None else out.union(one)
    every = W.partitionBy()
    return out.withColumns({"a": F.min("cutoff").over(every), "b": F.max("cutoff").over(every)}).where("a <> b").select("product", "cutoff")


def compare_reference(own: DataFrame, reference: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, own, reference, difference) of all keys of a published table."""
    both = reference.select(*keys, F.col(value).alias("reference")).join(own.select(*keys, F.col(value).alias("own")), keys, "left")
    return both.withColumn("difference", F.coalesce("own", F.lit(0)) - F.col("reference"))


@dataclass
class Contract:
    """What a table must look like: columns and their type classes, keys, text that may not be empty."""

    columns: dict[str, str]
    keys: list[str] = field(default_factory=list)
    not_empty: list[str] = field(default_factory=list)

    CLASSES = {
        "int": (T.ByteType, T.ShortType, T.IntegerType, T.LongType), "float": (T.FloatType, T.DoubleType, T.DecimalType), "text": (T.StringType,),
        "bool": (T.BooleanType,), "date": (T.DateType, T.TimestampType, T.TimestampNTZType), "list": (T.ArrayType,),
    }

    def schema_violations(self, df: DataFrame, spark: SparkSession) -> DataFrame:
        """(column, expected, found)."""
        found = {f.name: f.dataType for f in df.schema.fields}
        bad = [(c, k, found[c].simpleString() if c in found else None) for c, k in self.columns.items() if c not in found or not isinstance(found[c], self.CLASSES[k])]
        return spark.createDataFrame(bad, "column string, expected string, found string")

    def row_violations(self, df: DataFrame) -> DataFrame:
        """(rule, n) of the rules that rows break."""
        empties = [df.where(F.trim(c) == "").agg(F.count("*").alias("n")).select(F.lit(f"empty {c}").alias("rule"), "n") for c in self.not_empty]
        out = grain(df, self.keys).agg(F.count("*").alias("n")).select(F.lit("grain").alias("rule"), "n") if self.keys else None
        for e in empties:
            out = e if out is None else out.union(e)
        return out.where("n > 0")
