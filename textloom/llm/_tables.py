"""Tables, written intermediate results and connected components."""

from __future__ import annotations

import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm._text import mix

_own: dict[str, str] = {}


def shared(spark: SparkSession) -> str:
    """This application's own folder below the one that all executors share, spark.checkpoint.dir; below a temporary
    one only where that is unset and all tasks run on this machine. clear() removes it."""
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    key = spark.sparkContext.applicationId
    if not at:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = _own.get(key) or _own.setdefault(key, tempfile.mkdtemp(prefix="textloom-"))
    return f"{at.rstrip('/')}/textloom-{key}"


def written(df: DataFrame) -> DataFrame:
    """Runs df once and returns what it wrote to the shared folder, so that later steps don't repeat it and
    an executor's loss costs nothing that was done before."""
    path = f"{shared(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Removes all that written() made in this application; results that weren't saved can't be read any more."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(shared(spark))
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """The connected components of an undirected graph as (node, component); component is the least node.

    Alternating star contraction: large stars, then small stars, until the edges stay the same. Each round is
    a shuffle of the edges, never of paths, and long chains halve, so the rounds grow with the logarithm of the
    longest one. Edges with a null end and loops are ignored; no edges give no rows.
    """
    now = written(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct())
    before = None
    while True:
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if state["n"] == 0 or state == before:
            break
        before = state
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        now = written(small.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct())
    tops = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(tops)


def sieve(ids: DataFrame, bits: int = 24) -> Callable[[str | Column], Column]:
    """A test for doc_ids that may be in ids: never false for one that is. A bit map of fixed size (2 MB) is made
    in the executors and sent back to them; the fuller it gets, the more it lets through, and no result depends
    on that, as a join follows."""
    size = 1 << bits

    def place(x: np.ndarray) -> np.ndarray:
        return (mix(np.ascontiguousarray(x).view(np.uint64)) >> np.uint64(64 - bits)).astype(np.int64)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(size, bool)
        for batch in batches:
            seen[place(batch.column(0).to_numpy())] = True
        if seen.any():
            yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(np.packbits(seen).tobytes(), 1)], pa.binary())], names=["bits"])

    seen = np.zeros(size // 8, np.uint8)
    for r in ids.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").repartition(8).mapInArrow(build, "bits binary").toLocalIterator():
        seen |= np.frombuffer(zlib.decompress(r["bits"]), np.uint8)
    sent = ids.sparkSession.sparkContext.broadcast(seen)

    @F.arrow_udf("boolean")
    def test(x: pa.Array) -> pa.Array:
        at = place(pc.fill_null(x, 0).to_numpy(zero_copy_only=False))
        return pa.array((sent.value[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool), mask=x.is_null().to_numpy(zero_copy_only=False))

    return test
