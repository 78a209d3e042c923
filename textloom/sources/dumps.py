"""Dumps as DataFrames, and corpora as files."""

from __future__ import annotations

import bz2
import re
from collections.abc import Iterator
from pathlib import PurePosixPath

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

_SCHEMA = "title string, id long, revision struct<text: struct<_VALUE: string>>"


class DumpError(ValueError):
    """The path is no dump."""


def pages(spark: SparkSession, path: str) -> DataFrame:
    """(title, page_id, text) of a plain or bzip2 dump (multistream too), or of a directory of XML files.

    Files are split between tasks, bzip2 at its blocks. Malformed pages are left out.
    """
    kind = PurePosixPath(path.rstrip("/")).suffix
    if kind not in (".xml", ".bz2", "") and "*" not in path:
        raise DumpError(f"neither XML, bzip2 nor a directory: {path}")
    # pages are framed by their end tag, which also serves files of bare pages; what precedes the start tag is dropped
    reader = spark.read.option("lineSep", "</page>")
    raw = reader.option("pathGlobFilter", "*.xml*").text(path) if kind == "" else reader.text(path)
    return framed_pages(raw)


def framed_pages(raw: DataFrame) -> DataFrame:
    """(title, page_id, text) of text in column `value` that was split behind each page, as a batch or a stream."""
    raw = raw.select(F.make_valid_utf8("value").alias("value"))  # a byte that is no character doesn't lose the page
    framed = F.concat(F.lit("<page>"), F.substring_index("value", "<page>", -1), F.lit("</page>"))
    options = {"rowTag": "page", "mode": "PERMISSIVE", "ignoreSurroundingSpaces": "false", "valueTag": "_VALUE"}
    page = raw.where(F.contains("value", F.lit("<page>"))).select(F.from_xml(framed, _SCHEMA, options).alias("page"))
    text = F.regexp_replace(F.col("page.revision.text._VALUE"), r"(?s)<!--.*?-->", "\n")
    return page.select("page.title", F.col("page.id").alias("page_id"), text.alias("text")).where("title is not null")


def files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, length) of the files below a folder, by name."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    return found.select("path", "length").orderBy("path")


def index(spark: SparkSession, path: str) -> DataFrame:
    """(offset, page_id, title) of a multistream index, `offset:page_id:title` a line; titles may hold colons."""
    return index_of(spark.read.text(path))


def index_of(lines: DataFrame) -> DataFrame:
    """(offset, page_id, title) of index lines in column `value`."""
    parts = F.split("value", ":", 3)
    return lines.where(F.rlike("value", F.lit(r"^\d+:\d+:."))).select(parts[0].cast("long").alias("offset"), parts[1].cast("long").alias("page_id"), parts[2].alias("title"))


# bzip2


def bz2_problem(head: Column, length: Column) -> Column:
    """What is wrong with a file's first bytes, or null: native, over the binary source's columns."""
    h = F.hex(F.substring(head, 1, 4))
    return (
        F.when(length == 0, "empty").when(length < 14, "too small").when(F.substring(h, 1, 4) != "425A", "not bzip2").when(F.substring(h, 5, 2) != "68", "unknown version")
        .when(~F.rlike(F.substring(h, 7, 2), F.lit("^3[1-9]$")), "bad block size")
    )


def read_range(path: str, start: int, end: int | None) -> bytes:
    """Bytes of a file on any file system that Arrow knows (local, hdfs, s3, gs ...), to its end if `end` is None."""
    system, at = arrow_fs.FileSystem.from_uri(path) if re.match(r"[a-z0-9+]+:/", path) else (arrow_fs.LocalFileSystem(), path)
    with system.open_input_file(at) as f:
        return f.read_at((f.size() if end is None else min(end, f.size())) - start, start)


def write_bytes(path: str, content: bytes) -> None:
    """A small file, on any file system that Arrow knows."""
    system, at = arrow_fs.FileSystem.from_uri(path) if re.match(r"[a-z0-9+]+:/", path) else (arrow_fs.LocalFileSystem(), path)
    system.create_dir(str(PurePosixPath(at).parent))
    with system.open_output_stream(at, compression=None) as f:
        f.write(content)


def _unpacked(head: bytes) -> str | None:
    try:
        text = bz2.BZ2Decompressor().decompress(head, 4096)
    except (OSError, EOFError, ValueError):
        return "corrupt"
    return None if not text or re.search(rb"<\?xml|<mediawiki|<page", text) else "not XML"


def _listed(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """Files that a path or pattern names, or that lie in the folder; empty ones too, which a scan would pass over."""
    conf, at = spark.sparkContext._jsc.hadoopConfiguration(), spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(conf)
    found = [y for x in fs.globStatus(at) or [] for y in (fs.listStatus(x.getPath()) if x.isDirectory() else [x])]
    return [(x.getPath().toString(), x.getLen()) for x in found if x.isFile()]


def _heads(decompress: bool, size: int):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, length in zip(batch.column("path").to_pylist(), batch.column("length").to_pylist(), strict=True):
                head = read_range(path, 0, min(size, length))
                said = _unpacked(head) if decompress and head else None
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([length]), pa.array([head[:14]], pa.binary()), pa.array([said], pa.string())], names=["path", "length", "head", "said"])

    return f


def bz2_checked(spark: SparkSession, path: str, decompress: bool = True, size: int = 1 << 20) -> DataFrame:
    """(path, length, problem) of bzip2 files. Only the first `size` bytes of each are read, whatever its length; with
    `decompress`, the first chunk is unpacked and must look like XML."""
    listed = spark.createDataFrame(_listed(spark, path), "path string, length long")
    head = listed.repartition(max(1, min(64, listed.count()))).mapInArrow(_heads(decompress, size), "path string, length long, head binary, said string")
    return head.select("path", "length", F.coalesce(bz2_problem(F.col("head"), F.col("length")), "said").alias("problem"))


# random access by streams


class _Streams(InputPartition):
    def __init__(self, ranges: list[tuple[int, int | None]]):
        self.ranges = ranges


_STREAM_ROW = "offset long, page_id long, title string, text string"
_PAGE = re.compile(r"<page>(.*?)</page>", re.S)
_FIELDS = {k: re.compile(p, re.S) for k, p in {"title": r"<title>(.*?)</title>", "page_id": r"<id>(\d+)</id>", "text": r"<text[^>]*?(?:/>|>(.*?)</text>)"}.items()}


def _decoded(x: str) -> str:
    return x.replace("&lt;", "<").replace("&gt;", ">").replace("&quot;", '"').replace("&#039;", "'").replace("&amp;", "&")


def stream_pages(path: str, start: int, end: int | None) -> Iterator[tuple]:
    """(offset, page_id, title, text) of the pages in a stream of a multistream dump."""
    text = bz2.decompress(read_range(path, start, end)).decode("utf-8", "ignore")
    for m in _PAGE.finditer(text):
        found = {k: p.search(m[1]) for k, p in _FIELDS.items()}
        if found["title"]:
            page = found["page_id"]
            yield start, int(page[1]) if page else None, _decoded(found["title"][1]), _decoded((found["text"] and found["text"][1]) or "")


class _StreamReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.streams, self.tasks = options["path"], options["streams"], int(options.get("tasks", "64"))

    def partitions(self) -> list[InputPartition]:
        """Neighbouring streams share a task, so that there are `tasks` of them at most."""
        parts = (x.split("-") for x in self.streams.split(",") if x)
        ranges = sorted((int(a), int(z) if z else None) for a, z in parts)
        size = max(1, -(-len(ranges) // self.tasks))
        return [_Streams(ranges[k : k + size]) for k in range(0, len(ranges), size)]

    def read(self, part: _Streams) -> Iterator[tuple]:
        for start, end in part.ranges if part else ():
            yield from stream_pages(self.path, start, end)


class StreamSource(DataSource):
    """format("wikistreams"): the byte ranges `streams` ("0-100,100-") of a multistream dump, in `tasks` tasks at most."""

    @classmethod
    def name(cls) -> str:
        return "wikistreams"

    def schema(self) -> str:
        return _STREAM_ROW

    def reader(self, schema) -> DataSourceReader:
        return _StreamReader(self.options)


def in_streams(ranges: DataFrame, dump: str) -> DataFrame:
    """Pages of the streams in ranges (offset, next_offset). The ranges stay distributed, in tasks of neighbours."""
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, end in zip(batch.column("offset").to_pylist(), batch.column("next_offset").to_pylist(), strict=True):
                if rows := list(stream_pages(dump, start, end)):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)], names=["offset", "page_id", "title", "text"])

    parts = int(ranges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return ranges.select("offset", "next_offset").repartitionByRange(parts, "offset").mapInArrow(f, _STREAM_ROW)


def articles(spark: SparkSession, dump: str, index_: DataFrame, titles: DataFrame) -> DataFrame:
    """The pages of the titles asked for: their streams are found by joins, and only those are read."""
    from textloom.operators.relations import stream_ranges, streams_needed

    needed = stream_ranges(index_).join(streams_needed(index_, titles), "offset", "left_semi")
    return in_streams(needed, dump).join(titles.select("title").distinct(), "title", "left_semi")


# sinks


def write_corpus(rows: DataFrame, path: str, text: str = "output", records: int = 0, json: bool = False) -> None:
    """Non-blank records as text or JSON lines; `records` bounds those in a file (0: unbounded)."""
    kept = rows.where(F.col(text).isNotNull() & (F.trim(F.regexp_replace(text, r"\s+", " ")) != ""))
    out = kept.select(text).write.mode("errorifexists")
    if records:
        out = out.option("maxRecordsPerFile", records)
    if json:
        out.text(path) if dict(kept.dtypes)[text] == "string" else kept.select(F.to_json(text)).write.text(path)
    else:
        out.option("lineSep", "\n").text(path)


def output_name(base: str, number: Column, rotated: bool = True, json: bool = False) -> Column:
    end = ".jsonl" if json else ".txt"
    return F.concat(F.lit(f"{base}-"), number.cast("string"), F.lit(end)) if rotated else F.lit(base + end)
