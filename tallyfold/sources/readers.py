"""Sources: delimited files by year, projected scans, unions, snapshots, landed sheets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T


def delimited(spark: SparkSession, paths: dict[int, str], schema: T.StructType, last_latin_year: int, sep: str = ";") -> DataFrame:
    """Yearly files in one table: Latin-1 up to ``last_latin_year``, UTF-8 after; columns by header name."""
    parts = []
    for year, path in sorted(paths.items()):
        encoding = "ISO-8859-1" if year <= last_latin_year else "UTF-8"
        parts.append(spark.read.csv(path, schema=schema, sep=sep, header=True, encoding=encoding, enforceSchema=False))
    return union_all(parts)


def union_all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def scan(df: DataFrame, columns: list[str], keep: Column) -> DataFrame:
    """Only these rows and columns; both reach the Parquet scan."""
    return df.where(keep).select(*columns)


def yearly_union(parts: dict[int, DataFrame], expected: list[int]) -> DataFrame:
    """All years in one table; a year of the contract without a part is an error."""
    if missing := sorted(set(expected) - set(parts)):
        raise ValueError(f"missing years: {missing}")
    return union_all([parts[y].withColumn("source_year", F.lit(y)) for y in expected])


def same_schema_union(parts: dict[str, DataFrame]) -> DataFrame:
    """Sources with one schema, tagged with their name; a differing schema is an error."""
    shapes = {name: [(f.name, f.dataType) for f in df.schema.fields] for name, df in parts.items()}
    first = next(iter(shapes.values()))
    if odd := [n for n, s in shapes.items() if s != first]:
        raise ValueError(f"schemas differ from the first: {odd}")
    return union_all([df.withColumn("source", F.lit(name)) for name, df in parts.items()])


def latest_snapshot(rows: DataFrame, period: list[str], snapshot: str, source: str) -> DataFrame:
    """Of overlapping snapshots of a period only the newest; a period with two sources gets ``source_conflict``."""
    newest = rows.groupBy(*period).agg(F.max(snapshot).alias("__newest"), (F.count_distinct(source) > 1).alias("source_conflict"))
    return rows.join(newest, period).where(F.col(snapshot) == F.col("__newest")).drop("__newest")


def row_hash(columns: list[str]) -> Column:
    """SHA-256 of a row's fields as text, each after its length, so that no two different rows read the same."""
    field = lambda c: F.coalesce(F.concat(F.length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-"))
    return F.sha2(F.concat(*(field(F.col(c)) for c in columns)), 256)


def provenance(df: DataFrame, source: str, columns: list[str]) -> DataFrame:
    """``df`` with the source id and the SHA-256 of the row's raw fields."""
    return df.withColumns({"source_id": F.lit(source), "row_sha256": row_hash(columns)})


def fingerprint(df: DataFrame) -> DataFrame:
    """One row that does not depend on the order of rows: count, xor and sum of the first 60 bits of row hashes."""
    h = F.conv(F.substring(row_hash(df.columns), 1, 15), 16, 10).cast("long")
    return df.agg(F.count("*").alias("rows"), F.bit_xor(h).alias("xor_hash"), F.sum(h.cast("decimal(38,0)")).alias("sum_hash"))


def fill_down(rows: DataFrame, sheet: str, order: str, label: Column, name: str) -> DataFrame:
    """Rows below a label row inherit it."""
    return rows.withColumn(name, F.last(label, ignorenulls=True).over(W.partitionBy(sheet).orderBy(order).rowsBetween(W.unboundedPreceding, 0)))


def until_last(rows: DataFrame, sheet: str, order: str, is_data: Column) -> DataFrame:
    """Cuts what follows the last data row of each sheet."""
    last = F.max(F.when(is_data, F.col(order))).over(W.partitionBy(sheet))
    return rows.withColumn("__last", last).where(F.col(order) <= F.col("__last")).drop("__last")


def to_long(wide: DataFrame, keys: list[str], definitions: DataFrame) -> DataFrame:
    """Observations (keys, sex, indicator, unit, value) from a wide table.

    ``definitions`` (column, sex, indicator, unit) says what each column holds; it has one row per column.
    """
    columns = [c for c in wide.columns if c not in keys]
    long = wide.unpivot(keys, columns, "column", "value")
    return long.join(definitions, "column").select(*keys, "sex", "indicator", "unit", "value")


def encoding_audit(df: DataFrame, columns: list[str], marks: str = "[ÃÂ�]", top: int = 20) -> DataFrame:
    """(column, affected, distinct, rank, value, n): cells with marks of broken encoding, the most frequent first."""
    cells = df.select(*columns).unpivot([], columns, "column", "value").where(F.col("value").rlike(marks))
    by_value = cells.groupBy("column", "value").agg(F.count("*").alias("n"))
    rank = F.row_number().over(W.partitionBy("column").orderBy(F.desc("n"), "value"))
    whole = by_value.groupBy("column").agg(F.sum("n").alias("affected"), F.count("*").alias("distinct"))
    return by_value.withColumn("rank", rank).where(F.col("rank") <= top).join(whole, "column").select("column", "affected", "distinct", "rank", "value", "n")


def date_bounds(c: Column, form: str = "dd/MM/yyyy") -> tuple[Column, Column]:
    """Aggregates: first and last day of dates in text, in order of time."""
    day = F.try_to_timestamp(c, F.lit(form)).cast("date")
    return F.min(day), F.max(day)
