"""A multistream index as Parquet beside the mark of the file that it came from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.sources import dumps

VERSION = 1
_MARK = "version int, source string, length long, modified timestamp, entries long"


def _source(spark: SparkSession, index: str) -> DataFrame:
    """Length and time of the index file: the file's name is listed, its content isn't read."""
    return spark.read.format("binaryFile").load(index).select("length", F.col("modificationTime").alias("modified"))


def _there(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def valid(spark: SparkSession, index: str, cache: str) -> bool:
    """Whether the cache is of this version and the index file has kept its length and time."""
    if not (_there(spark, index) and _there(spark, f"{cache}/mark/_SUCCESS") and _there(spark, f"{cache}/entries/_SUCCESS")):
        return False
    mark = spark.read.schema(_MARK).parquet(f"{cache}/mark").where(F.col("version") == VERSION)
    return not mark.join(_source(spark, index), ["length", "modified"], "left_semi").isEmpty()


def save(spark: SparkSession, index: str, cache: str) -> None:
    """Parses the index once and writes it by title; the mark comes last, so that a broken write isn't valid."""
    entries = dumps.index(spark, index)
    entries.repartitionByRange("title").write.mode("overwrite").parquet(f"{cache}/entries")
    n = spark.read.parquet(f"{cache}/entries").count()
    mark = _source(spark, index).select(F.lit(VERSION).alias("version"), F.lit(index).alias("source"), "length", "modified", F.lit(n).cast("long").alias("entries"))
    mark.coalesce(1).write.mode("overwrite").parquet(f"{cache}/mark")


def load(spark: SparkSession, index: str, cache: str) -> DataFrame:
    """(offset, page_id, title) from the cache, which is made first if it isn't valid. Lookups of titles prune files."""
    if not valid(spark, index, cache):
        save(spark, index, cache)
    return spark.read.schema("offset long, page_id long, title string").parquet(f"{cache}/entries")


def stats(spark: SparkSession, cache: str) -> DataFrame:
    return spark.read.schema(_MARK).parquet(f"{cache}/mark")
