"""Small helpers shared by the operators of this package."""

from __future__ import annotations

import gc
import os
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfold.sources.shared import shared_dir


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later plans start from the files."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def whole_text(col: str = "text"):
    return F.coalesce(F.col(col), F.lit(""))


def shipped(spark: SparkSession, path: str) -> Callable[[], str]:
    """Sends a file of the driver to all executors; the result gives the path of its copy there."""
    spark.sparkContext.addFile(path)
    name = os.path.basename(path)

    def local() -> str:
        from pyspark import SparkFiles

        return SparkFiles.get(name)

    return local


def squeeze(a: np.ndarray, level: int = 3) -> bytes:
    """An array's bytes, compressed."""
    return zstandard.ZstdCompressor(level=level).compress(a.tobytes())


def expand(data, kind) -> np.ndarray:
    """The array of ``squeeze``, from bytes or an array of them."""
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), kind)


def slices(batches, column: int, limit: int = 1 << 20):
    """The same rows in batches whose ``column`` holds about ``limit`` bytes, or one longer value."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            floor = ends[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(ends, floor + limit, "right")))
            yield batch.slice(at, end - at)
            at = end


def release(spark: SparkSession) -> None:
    """Lets Spark drop the shuffle files of plans that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
