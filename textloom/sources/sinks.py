"""Corpora as numbered files of bounded size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.sources import scratch
from textloom.sources.dumps import output_name

MB = 1 << 20


class SinkError(OSError):
    """The file system refused what was to be written."""


def non_blank(rows: DataFrame, text: str) -> DataFrame:
    return rows.where(F.col(text).isNotNull() & F.rlike(text, F.lit(r"\S")))


def running_bytes(rows: DataFrame, text: str, order: str) -> DataFrame:
    """rows with `before`: the bytes of all records of smaller `order`, each with its line end. Rows are sorted by
    ranges, sums run inside a range, and only one sum for each range is put in order."""
    spark = rows.sparkSession
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    placed = scratch.written(rows.repartitionByRange(int(parts), order).withColumn("_part", F.spark_partition_id()).withColumn("_size", (F.octet_length(text) + 1).cast("long")))
    sums = placed.groupBy("_part").agg(F.sum("_size").alias("n"))
    base = sums.select("_part", F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    inside = F.sum("_size").over(Window.partitionBy("_part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    return placed.join(F.broadcast(base), "_part").withColumn("before", F.col("_base") + F.coalesce(inside, F.lit(0))).drop("_part", "_size", "_base")


def write_rotated(rows: DataFrame, folder: str, base: str, text: str = "output", order: str = "title", file_mb: float = 10, json: bool = False) -> list[str]:
    """Non-blank records, by `order`, as base-1.txt, base-2.txt ... (.jsonl with `json`), each begun anew when the bytes
    before reach a multiple of file_mb; with file_mb = 0 all in base.txt, by one task. Returns the names; no record,
    no file. Each file is written by a task of its own; on the driver they are only renamed. SinkError if the file
    system refuses. Ties in `order` may come in any order."""
    spark = rows.sparkSession
    kept = non_blank(rows.select(order, text), text)
    if file_mb:
        kept = running_bytes(kept, text, order).withColumn("_file", F.floor(F.col("before") / int(file_mb * MB)).cast("long") + 1)
    else:
        kept = kept.withColumn("_file", F.lit(1).cast("long"))
    to = scratch.place(spark)
    named = kept.withColumn("_name", output_name(base, F.col("_file"), rotated=bool(file_mb), json=json))
    try:
        named.repartition("_name").sortWithinPartitions("_name", order).select("_name", F.col(text).alias("value")).write.partitionBy("_name").text(to)
        jvm = spark.sparkContext._jvm
        source, target = jvm.org.apache.hadoop.fs.Path(to), jvm.org.apache.hadoop.fs.Path(folder)
        fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        fs.mkdirs(target)
        names = []
        for made in source.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(jvm.org.apache.hadoop.fs.Path(to, "_name=*/part-*")) or []:
            name = made.getPath().getParent().getName().removeprefix("_name=")
            if not fs.rename(made.getPath(), jvm.org.apache.hadoop.fs.Path(folder, name)):
                raise SinkError(f"{name} can't be put into {folder}")
            names.append(name)
        fs.delete(source, True)
    except SinkError:
        raise
    except Exception as error:
        raise SinkError(str(error).splitlines()[0]) from error
    return sorted(names, key=lambda n: (len(n), n))
