"""Publishing tables: staged, checked, then put in place all at once.

Every publish writes new version folders. What readers see is decided by the publish log, a table of (version, table,
path) beside them: the rows of one publish are one file of the log, so that either all of its tables change or none.
A write or a check that fails leaves the old versions as they were.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfold.sources.readers import fingerprint

Checks = dict[str, Callable[[DataFrame], DataFrame]]
_LOG = "version long, table string, path string"


def publish_together(root: str, tables: dict[str, tuple[DataFrame, Checks]], partition_by: dict[str, list[str]] | None = None) -> dict[str, DataFrame]:
    """Writes new versions of tables under ``root``, reads them back, runs the checks and only then lists them.

    Each check returns offending rows. The published tables are returned. One publisher at a time writes to a root.
    """
    tag, staged = uuid.uuid4().hex, {}
    for name, (df, checks) in tables.items():
        path = f"{root}/{name}/{tag}"
        writer = df.write
        if partition_by and partition_by.get(name):
            writer = writer.partitionBy(*partition_by[name])
        writer.parquet(path)
        back = df.sparkSession.read.schema(df.schema).parquet(path)
        if failed := [k for k, check in checks.items() if not check(back).isEmpty()]:
            raise ValueError(f"{name}: checks failed: {failed}")
        staged[name] = path
    spark = next(iter(tables.values()))[0].sparkSession
    version = (newest(spark, root).agg(F.max("version")).first()[0] or 0) + 1
    # one file, which the commit of the job moves into place
    spark.createDataFrame([(version, name, path) for name, path in staged.items()], _LOG).coalesce(1).write.mode("append").parquet(f"{root}/_published")
    return {name: published(spark, root, name, tables[name][0].schema) for name in tables}


def newest(spark: SparkSession, root: str) -> DataFrame:
    """(table, version, path): the version of each table that readers see; one row per table. Reading writes nothing."""
    try:
        log = spark.read.schema(_LOG).parquet(f"{root}/_published")
    except AnalysisException as e:
        # nothing has been published there yet
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        log = spark.createDataFrame([], _LOG)
    return log.groupBy("table").agg(F.max("version").alias("version"), F.max_by("path", "version").alias("path"))


def published(spark: SparkSession, root: str, name: str, schema=None) -> DataFrame:
    """The newest published version of a table."""
    row = newest(spark, root).where(F.col("table") == name).first()
    if row is None:
        raise ValueError(f"{name} has never been published")
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(row["path"])


def publish(df: DataFrame, root: str, name: str, checks: Checks, partition_by: list[str] | None = None) -> DataFrame:
    """One table, as ``publish_together``."""
    return publish_together(root, {name: (df, checks)}, {name: partition_by or []})[name]


def write_delimited(df: DataFrame, path: str, sep: str = ";") -> None:
    df.write.mode("overwrite").csv(path, sep=sep, header=True)


def record_snapshot(log_path: str, source: str, url: str, table: DataFrame) -> DataFrame:
    """Appends a line with the table's fingerprint to the provenance log, and returns the log."""
    line = fingerprint(table).select(F.lit(source).alias("source_id"), F.lit(url).alias("url"), "rows", "xor_hash", F.current_timestamp().alias("read_at"))
    line.write.mode("append").parquet(log_path)
    return table.sparkSession.read.parquet(log_path)


def period_prints(table: DataFrame, period: str) -> DataFrame:
    """(period, rows, first_sum, second_sum): a fingerprint of each period's rows as a multiset.

    Sums of two keyed hashes: equal rows add up instead of cancelling, the order of rows does not matter, and prints of
    parts can be added (``merged_prints``). Nulls are told from values by their places.
    """
    nulls = F.concat(*(F.when(F.col(c).isNull(), "1").otherwise("0") for c in table.columns))
    sums = [F.sum(F.xxhash64(F.lit(seed), nulls, *table.columns).cast("decimal(38,0)")).alias(name) for seed, name in ((11, "first_sum"), (23, "second_sum"))]
    return table.groupBy(period).agg(F.count(F.lit(1)).alias("rows"), *sums)


def merged_prints(parts: list[DataFrame], period: str) -> DataFrame:
    """The prints of the union of tables, from theirs: what is known of a period is never read again."""
    every = parts[0]
    for more in parts[1:]:
        every = every.unionByName(more)
    return every.groupBy(period).agg(*(F.sum(c).cast("long" if c == "rows" else "decimal(38,0)").alias(c) for c in ("rows", "first_sum", "second_sum")))


def changed_periods(new: DataFrame, old: DataFrame, period: str) -> DataFrame:
    """(period): where prints differ or are there on one side only."""
    names = ("rows", "first_sum", "second_sum")
    both = new.alias("a").join(old.alias("b").hint("merge"), F.col(f"a.{period}").eqNullSafe(F.col(f"b.{period}")), "full")
    same = F.lit(True)
    for c in names:
        same &= F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    return both.where(~same).select(F.coalesce(f"a.{period}", f"b.{period}").alias(period))


def refresh_period(table: DataFrame, target: str, period: str, old: DataFrame | None) -> list:
    """Rewrites the periods of ``table`` whose print differs from ``old`` (as ``period_prints`` made it); returns those periods.

    Periods that ``table`` does not hold stay as they are. The number of periods is that of years or days, so their list
    has a bound.
    """
    new = period_prints(table, period)
    changed = new if old is None else changed_periods(new, old, period).join(new.select(period).hint("merge"), period, "left_semi")
    periods = sorted(r[0] for r in changed.select(period).collect())
    if periods:
        table.where(F.col(period).isin(periods)).write.mode("overwrite").partitionBy(period).option("partitionOverwriteMode", "dynamic").parquet(target)
    return periods


def append_periods(batch: DataFrame, target: str, period: str, prints: DataFrame | None) -> DataFrame:
    """Adds a batch to the periods' folders, and returns the prints of all rows now there: those before plus the batch's."""
    own = period_prints(batch, period)
    batch.write.mode("append").partitionBy(period).parquet(target)
    return own if prints is None else merged_prints([prints, own], period)
