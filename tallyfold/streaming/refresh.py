"""Refreshing a table by period from a file stream, and weekly counts that wait for late rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH = "__batch"


def by_period(spark: SparkSession, source: str, target: str, state: str, schema: str, period: str) -> None:
    """Reads what has arrived since the last run and rewrites the periods that it touches.

    Rows of a period may come in several batches: a touched period is rewritten with its old rows and the new ones,
    equal rows included. Each row carries the number of its batch, so that a batch that runs again replaces what it
    wrote the first time. ``current`` reads the table without that column.
    """
    full = f"{schema}, {BATCH} long"
    # an empty append makes the table where there is none
    spark.createDataFrame([], full).write.mode("append").partitionBy(period).parquet(target)

    def put(batch: DataFrame, number: int) -> None:
        columns = [*batch.columns, BATCH]
        touched = batch.select(period).distinct()
        old = spark.read.schema(full).parquet(target).select(*columns).where(F.col(BATCH) != number).join(touched, period, "left_semi")
        staged = f"{state}/staged-{number}"
        old.select(*columns).union(batch.withColumn(BATCH, F.lit(number).cast("long"))).write.mode("overwrite").parquet(staged)
        spark.read.schema(full).parquet(staged).write.mode("overwrite").partitionBy(period).option("partitionOverwriteMode", "dynamic").parquet(target)

    stream = spark.readStream.schema(schema).parquet(source)
    query = stream.writeStream.foreachBatch(put).option("checkpointLocation", f"{state}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()


def current(spark: SparkSession, target: str, schema: str) -> DataFrame:
    return spark.read.schema(f"{schema}, {BATCH} long").parquet(target).drop(BATCH)


def weekly_counts(events: DataFrame, time: str, keys: list[str], late: str = "3 days") -> DataFrame:
    """Counts per week (from Sunday) and keys on a stream; a week is given out once no late row can reach it."""
    week = F.window(time, "7 days", startTime="3 days")
    return events.withWatermark(time, late).groupBy(week.alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("week_start"), *keys, "n")
