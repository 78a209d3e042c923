"""Substring dedup by level-wise doubling.

A window of `least` words that occurs at two or more places of the corpus (in one document or in several) is
repeated. Windows that repeat at one length alone are extended to twice that length, until none survives.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm import _text as tx
from textloom.llm._lean import lean
from textloom.llm._anchors import of_content, repeated, several, size_of, texts_with
from textloom.llm._tables import written

_STRETCH = "doc_id long, c long, start int, words binary"


def _first(least: int):
    k, span = size_of(least)

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in tx.pieces(batch, "text"):
                ids, w = piece.column("doc_id").to_numpy(), tx.scan(piece.column("text"))
                out: list[tuple[int, int, int, bytes]] = []
                for i, c, at in of_content(piece, w):
                    h = w.hash[w.first[i] : w.first[i + 1]]
                    mark = np.zeros(len(h) + 1, np.int32)
                    np.add.at(mark, np.maximum(at - span + 1, 0), 1)
                    np.add.at(mark, at + 1, -1)
                    a, z = tx.runs((np.cumsum(mark)[: len(h) - least + 1]) > 0)
                    out += [(ids[i], c, s, h[s : e - 1 + least].tobytes()) for s, e in zip(a.tolist(), z.tolist(), strict=True)]
                if out:
                    d, c_, s_, b_ = zip(*out, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(c_, pa.int64()), pa.array(s_, pa.int32()), pa.array(b_, pa.binary())], names=["doc_id", "c", "start", "words"])

    return f


def _windows(length: int):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, cs, starts, words = (batch.column(x) for x in ("doc_id", "c", "start", "words"))
            parts: list[tuple[np.ndarray, ...]] = []
            held = 0

            def rows() -> pa.RecordBatch:
                cols = [np.concatenate(x) for x in zip(*parts, strict=True)]
                return pa.RecordBatch.from_arrays([pa.array(x) for x in cols], names=["h", "g", "doc_id", "c", "start", "i"])

            for r in range(batch.num_rows):
                h = np.frombuffer(words[r].as_py(), np.uint64)
                g = tx.grams(h, length)
                n = len(g)
                parts.append((tx.signed(g), tx.signed(tx.grams(tx.mix(h ^ np.uint64(length)), length)), np.full(n, ids[r].as_py(), np.int64), np.full(n, cs[r].as_py(), np.int64), np.full(n, starts[r].as_py(), np.int32), np.arange(n, dtype=np.int32)))
                held += n
                if held > 1 << 17:
                    yield rows()
                    parts, held = [], 0
            if parts:
                yield rows()

    return f


def _extend(length: int):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[int, int, int, int, bytes | None]] = []
            for r in batch.to_pylist():
                h, start = np.frombuffer(r["words"], np.uint64), r["start"]
                ok = np.zeros(len(h) - length + 1, bool)
                ok[r["at"]] = True
                for a, z in zip(*tx.runs(ok), strict=True):
                    out.append((r["doc_id"], r["c"], start + int(a), start + int(z) - 1 + length, None))
                if len(h) >= 2 * length:
                    n = len(h) - 2 * length + 1
                    for a, z in zip(*tx.runs(ok[:n] & ok[length : length + n]), strict=True):
                        out.append((r["doc_id"], r["c"], start + int(a), 0, h[a : z - 1 + 2 * length].tobytes()))
            if out:
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["doc_id", "c", "start", "end", "words"])

    return f


def repeated_passages(docs: DataFrame, least: int = 50) -> DataFrame:
    """Every stretch of a document that is covered by repeated windows of `least` words.

    Takes doc_id and text of docs, whatever else it has. Returns (doc_id, start_word, end_word, longest): words
    start_word to end_word - 1 are all in repeated windows, and longest is the longest of the lengths
    least, 2 * least, 4 * least ... at which a window inside repeats; where the whole document has another copy
    (the same words), it is one stretch, and longest its words. Words are those of _text.

    Null doc_id: the row takes no part. Null or empty text, and texts shorter than `least` words: no stretch.
    Repeated rows, and documents with the same words, are copies of each other. Rows that share a doc_id and
    differ in text are separate documents. Very long texts count whole. No documents: no rows. Ties don't arise: all
    occurrences are reported.
    """
    found = repeated(docs, least)
    copies = found.where("pos < 0").select("doc_id", F.lit(0).alias("start_word"), (-F.col("pos")).alias("end_word"), (-F.col("pos")).alias("longest"), "c").distinct()
    stretches = written(texts_with(docs, found).mapInArrow(lean(_first(least)), _STRETCH))
    length, spans = least, []
    while not stretches.isEmpty():
        rows = written(stretches.mapInArrow(lean(_windows(length)), "h long, g long, doc_id long, c long, start int, i int"))
        at = several(rows, "h", "g").groupBy("doc_id", "c", "start").agg(F.collect_list("i").alias("at"))
        step = written(stretches.join(at.hint("shuffle_hash"), ["doc_id", "c", "start"]).mapInArrow(lean(_extend(length)), "doc_id long, c long, start int, end int, words binary"))
        spans.append(step.where("words is null").select("doc_id", "c", "start", "end", F.lit(length).alias("length")))
        stretches = step.where("words is not null").select("doc_id", "c", "start", "words")
        length *= 2
    whole = copies.select("doc_id", "start_word", "end_word", "longest")
    if not spans:
        return whole
    base = spans[0].join(copies.select("doc_id", "c"), ["doc_id", "c"], "left_anti").select("doc_id", "c", F.col("start").alias("start_word"), F.col("end").alias("end_word"))
    longer = spans[0]
    for s in spans[1:]:
        longer = longer.union(s)
    inside = (F.col("start") >= F.col("start_word")) & (F.col("end") <= F.col("end_word"))
    parts = base.join(longer, ["doc_id", "c"]).where(inside).groupBy("doc_id", "c", "start_word", "end_word").agg(F.max("length").alias("longest"))
    return parts.select("doc_id", "start_word", "end_word", "longest").union(whole)
