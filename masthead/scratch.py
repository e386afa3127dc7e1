"""Scratch tables in the folder that the cluster shares."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Where scratch tables go when a *local* session names no shared folder.
LOCAL = "/tmp/checkpoints"


def root(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; only a local session may leave it unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return LOCAL


def fixed(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later plans start from the files."""
    path = f"{root(df.sparkSession).rstrip('/')}/masthead/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
