"""Exact dedup by a tree merge of sorted digest runs.

Every input partition sorts the digests of its texts into a run and keeps the smallest doc_id of each. In round
r, `fan` neighbouring runs of the round before are exchanged, each by ranges of digests, and merged as they lie,
again keeping the smallest, so that after log_fan(partitions) rounds one run is left. Copies leave at the lowest
level that sees them: a text with a million copies sends at most one row from each run upwards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm._lean import lean
from textloom.llm._tables import partitions, sieve, written

_RUN = "run long, digest binary, doc_id long, lost boolean"
_WIDTH = 40
_NO_TEXT = b"\xff" * _WIDTH
Run = tuple[np.ndarray, np.ndarray]


def digested(docs: DataFrame) -> DataFrame:
    """docs with `digest`: SHA-256 and length of the text's bytes; for null text, a value of its own."""
    text = F.col("text").cast("string")
    digest = F.concat(F.unhex(F.sha2(text, 256)), F.unhex(F.lpad(F.hex(F.octet_length(text).cast("long")), 16, "0")))
    return docs.withColumn("digest", F.coalesce(digest, F.lit(_NO_TEXT)))


def merged(a: Run, b: Run) -> tuple[Run, Run]:
    """(run, lost): two sorted runs of distinct digests as one with the smaller doc_id of each digest, and the rows
    that had the larger one. Neither run is sorted again: places come by search of one in the other."""
    at = np.minimum(np.searchsorted(a[0], b[0]), max(len(a[0]) - 1, 0))
    same = a[0][at] == b[0] if len(a[0]) else np.zeros(len(b[0]), bool)
    hit, mine, other = at[same], a[1][at[same]], b[1][same]
    lost = b[0][same], np.maximum(mine, other)
    ids = a[1].copy()
    ids[hit] = np.minimum(mine, other)
    new = ~same
    place = np.searchsorted(a[0], b[0][new])
    return (np.insert(a[0], place, b[0][new]), np.insert(ids, place, b[1][new])), lost


def _run_of(batches: list[pa.RecordBatch]) -> Run:
    digest = np.concatenate([np.frombuffer(b"".join(b.column("digest").to_pylist()), f"S{_WIDTH}") for b in batches])
    return digest, np.concatenate([b.column("doc_id").to_numpy() for b in batches])


def _rows(run: Run, number: int, lost: bool) -> Iterator[pa.RecordBatch]:
    digest, ids = run
    for a in range(0, len(ids), 1 << 16):
        d = digest[a : a + (1 << 16)]
        held = pa.FixedSizeBinaryArray.from_buffers(pa.binary(_WIDTH), len(d), [None, pa.py_buffer(np.ascontiguousarray(d))]).cast(pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(d), number, np.int64)), held, pa.array(ids[a : a + (1 << 16)]), pa.array(np.full(len(d), lost))], names=["run", "digest", "doc_id", "lost"])


def _sorted_run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The run of a partition of documents, and the rows that are copies within it."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    digest, ids = _run_of(held)
    order = np.lexsort((ids, digest))
    digest, ids = digest[order], ids[order]
    lost = np.append(False, digest[1:] == digest[:-1])
    number = TaskContext.get().partitionId()
    yield from _rows((digest[~lost], ids[~lost]), number, False)
    yield from _rows((digest[lost], ids[lost]), number, True)


def _merged_runs(fan: int):
    """One range of digests of `fan` runs of a group, each in its order, by pairs of pairs."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[pa.RecordBatch]] = {}
        for batch in batches:
            run = batch.column("run").to_numpy()
            for a, z in zip(cut := [0, *(np.flatnonzero(np.diff(run)) + 1).tolist()], [*cut[1:], len(run)], strict=True):
                if z > a:
                    held.setdefault(int(run[a]), []).append(batch.slice(a, z - a))
        if not held:
            return
        number = min(held) // fan
        runs = []
        for k in sorted(held):
            digest, ids = _run_of(held.pop(k))
            if (digest[1:] < digest[:-1]).any():  # only if the exchange didn't keep a run's order
                order = np.argsort(digest, kind="stable")
                digest, ids = digest[order], ids[order]
            runs.append((digest, ids))
        while len(runs) > 1:
            level = []
            for k in range(0, len(runs) - 1, 2):
                run, lost = merged(runs[k], runs[k + 1])
                level.append(run)
                yield from _rows(lost, number, True)
            runs = level + runs[len(level) * 2 :]
        yield from _rows(runs[0], number, False)

    return f


def copies(docs: DataFrame, fan: int = 8) -> DataFrame:
    """A row (doc_id, keep_id, digest) for every row of docs that is a copy of another.

    Texts are copies if their bytes are equal (verified at every level by 256-bit digest and length, as texts don't
    travel). keep_id is the smallest doc_id that has the text. Empty texts are copies of each other, null texts of
    each other. Repeated rows: each but one is listed, with doc_id = keep_id. A null doc_id takes no part. Very long
    texts are digested whole. Ties don't arise: of equal doc_ids either is the smallest. No documents: no rows.
    Other columns are ignored, whatever their names.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    level = written(digested(rows).select("digest", "doc_id").mapInArrow(lean(_sorted_run), _RUN))
    gone = level.where("lost").select("digest", "doc_id")
    left = level.where("not lost").select("run", "digest", "doc_id")
    most = left.agg(F.max("run")).first()[0] or 0
    parts = partitions(docs.sparkSession)
    while most:
        most //= fan
        # a group's runs meet in as many tasks as there are ranges, more in later rounds, so that all cores are busy
        ranges = max(1, -(-parts // (most + 1)))
        high = F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("long")
        place = F.floor(F.col("run") / fan) * ranges + F.shiftright(high * ranges, 32)
        level = written(left.repartitionById((most + 1) * ranges, place.cast("int")).mapInArrow(lean(_merged_runs(fan)), _RUN))
        gone = gone.union(level.where("lost").select("digest", "doc_id"))
        left = level.where("not lost").select("run", "digest", "doc_id")
    return gone.join(left.select("digest", F.col("doc_id").alias("keep_id")), "digest").select("doc_id", "keep_id", "digest")


def without_copies(docs: DataFrame, fan: int = 8) -> DataFrame:
    """docs with the row of smallest doc_id of each text only, with all columns.

    Only rows whose doc_id may be a copy's are shuffled. Rows of null doc_id stay, as does one row of null text and
    one of empty text. Of repeated rows, the one that is kept has the least of the other columns' hashes. Very long
    texts count whole. Rows that share a doc_id and differ in text are separate. No documents: no rows. Other columns
    come along, whatever their names.
    """
    gone = copies(docs.select("doc_id", "text"), fan).groupBy(F.col("doc_id").alias("_id_"), "digest").agg(F.min(F.col("doc_id") == F.col("keep_id")).alias("_same_"))
    gone = written(gone)
    maybe = F.coalesce(sieve(gone.select(F.col("_id_").alias("doc_id")))(F.col("doc_id").cast("long")), F.lit(False))
    held = digested(docs.where(maybe).select(F.struct("*").alias("_row_"), F.col("doc_id").cast("long").alias("_id_"), F.col("text")))
    found = held.drop("text").join(gone, ["_id_", "digest"], "left")
    first = Window.partitionBy("_id_", "digest", "_same_").orderBy(F.xxhash64("_row_"))
    known = found.where("_same_").withColumn("_k_", F.row_number().over(first)).where("_k_ = 1").select("_row_.*")
    return docs.where(~maybe).union(found.where("_same_ is null").select("_row_.*")).union(known)
