"""Dumps that arrive in a folder, as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import columns as C
from textloom.functions import udfs as U
from textloom.operators import articles
from textloom.sources import dumps


def arriving_pages(spark: SparkSession, folder: str) -> DataFrame:
    """(title, text) of Parquet files as they arrive; redirects and other namespaces are left out."""
    rows = spark.readStream.schema("title string, text string").parquet(folder)
    return articles.main_pages(rows)


def arriving_dump(spark: SparkSession, folder: str) -> DataFrame:
    """(title, page_id, text) of articles in XML dumps, plain or bzip2, as they arrive; stateless."""
    raw = spark.readStream.option("lineSep", "</page>").option("pathGlobFilter", "*.xml*").text(folder)
    return articles.main_pages(dumps.framed_pages(raw))


def arrivals(events: DataFrame, at: str, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(start, count) of rows by windows of event time; a window is closed, and its state dropped, once the latest
    time seen is `late` past its end."""
    return events.withWatermark(at, late).groupBy(F.window(at, window)).agg(F.count("*").alias("count")).select(F.col("window.start").alias("start"), "count")


def run_to(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Takes in what has arrived, appends it to Parquet files and returns these; a later call goes on from there."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def running_section_counts(pages: DataFrame) -> DataFrame:
    """Counts of headings so far; for output mode complete. Its state is one row for each heading name."""
    found = pages.select(U.elements(F.col("text")).alias("elements")).select(F.explode(articles.headings()).alias("h"))
    return found.groupBy(F.col("h.name").alias("name")).agg(F.count("*").alias("count"))


def arriving_categories(pages: DataFrame) -> DataFrame:
    """(title, category) of each page, stateless; for output mode append."""
    return pages.select("title", F.explode(C.categories("text")).alias("category"))
