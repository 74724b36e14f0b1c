"""Tables kept in the folder that the driver and the executors share."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``.

    Only a session on one machine may leave it out; it gets a temporary folder, which goes with the process.
    """
    there = spark.conf.get("spark.checkpoint.dir", None)
    if not there:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="tallyfold-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        there = f"file://{folder}"
        spark.conf.set("spark.checkpoint.dir", there)
    return there


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: later plans start from its files, of known size."""
    path = os.path.join(shared_dir(df.sparkSession), f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
