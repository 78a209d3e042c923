"""Intermediate files in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def root(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder only where that is unset and all tasks run on this machine."""
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        key = spark.sparkContext.applicationId
        at = _own.get(key) or _own.setdefault(key, tempfile.mkdtemp(prefix="corpus-"))
    return at.rstrip("/")


def place(spark: SparkSession) -> str:
    """A new path below root()."""
    return f"{root(spark)}/scratch-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """Runs df once and returns what it wrote: what follows has a plan of its own, however long the way was."""
    path = place(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
