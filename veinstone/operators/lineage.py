"""Cutting lineage through tables in the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where none is set: in local mode a new one of our own; a cluster's executors would not
    share that, so there it is an error."""
    known = spark.conf.get("spark.checkpoint.dir", None)
    if not known:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        known = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", known)
    return known.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """Writes df as a Parquet table in the shared folder and reads it back: later jobs, and retries after a lost
    executor, start from those files. The folder's owner clears it after the run, as with any checkpoint."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/t-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
