"""Places where a text may repeat a passage: a lossless first sieve for the two repeated-passage operators.

Of every `least` consecutive words, the (least // 2)-word window with the smallest hash is an anchor. Equal
passages of `least` words have equal anchors, so a passage whose anchors occur once in the corpus doesn't
repeat; about 8 % of the positions are anchors, which is what is shuffled instead of every window.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm import _text as tx
from textloom.llm._lean import lean
from textloom.llm._tables import written


def size_of(least: int) -> tuple[int, int]:
    """Words of an anchor, and anchors' windows in a passage of `least` words."""
    k = max(1, least // 2)
    return k, least - k + 1


def content(hashes: np.ndarray) -> tuple[int, int]:
    """Two 64-bit values of a sequence of words."""
    d = np.frombuffer(hashlib.blake2b(hashes.tobytes(), digest_size=16).digest(), np.int64)
    return int(d[0]), int(d[1])


def windows(w: tx.Words, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash by position, start of each window of `least` words inside one text, its anchor's position)."""
    k, span = size_of(least)
    if len(w.hash) < least:
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none
    g = tx.grams(w.hash, k)
    low = tx.slide(g, span)
    start = np.flatnonzero(np.arange(len(low)) + least <= w.last()[: len(low)])
    if not len(start):
        return g, start, start
    # the leftmost position of the least hash: blocks of equal minima end where the position leaves the window
    at = np.full(len(low), -1, np.int64)
    left = np.arange(len(low))
    for step in range(span):
        open_ = left[g[left + step] == low[left]]
        at[open_] = open_ + step
        left = left[g[left + step] != low[left]]
        if not len(left):
            break
    return g, start, at[start]


def prepared(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")


def _rows(least: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    names = ["h", "c", "pos", "doc_id"]

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in tx.pieces(batch, "text"):
                ids = piece.column("doc_id").to_numpy()
                w = tx.scan(piece.column("text"))
                n = np.diff(w.first)
                long = np.flatnonzero(n >= least)
                if not len(long):
                    continue
                both = np.array([content(w.hash[w.first[i] : w.first[i + 1]]) for i in long])
                c = np.zeros(len(n), np.int64)
                c[long] = both[:, 0]
                g, _, at = windows(w, least)
                pos = np.unique(at)
                doc = np.searchsorted(w.first, pos, side="right") - 1
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([tx.signed(g[pos]), both[:, 1]])),
                        pa.array(np.concatenate([c[doc], both[:, 0]])),
                        pa.array(np.concatenate([pos - w.first[doc], -n[long]]).astype(np.int32)),
                        pa.array(np.concatenate([ids[doc], ids[long]])),
                    ],
                    names=names,
                )

    return f


def _spot() -> Column:
    """A number for a place: of two places of an anchor, different ones have the same with a chance of 2 ** -64."""
    return F.xxhash64("c", "pos")


def several(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows whose keys two or more rows have. rows are read twice, so they should be written; a key that many rows have
    is counted before the exchange, and its rows are divided among tasks by the join."""
    often = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n_")).where("_n_ > 1").drop("_n_")
    return rows.join(often, list(keys))


def repeated(docs: DataFrame, least: int) -> DataFrame:
    """Written rows (h, c, pos, doc_id): anchors that occur at two or more places, in the smallest doc_id of
    each content c; and, with pos = -words, each document of which there is more than one copy.

    Counts are aggregated before they are exchanged, and joined back, so that an anchor that a third of all documents
    hold, or a text with as many copies, is no task's group."""
    rows = written(prepared(docs).mapInArrow(lean(_rows(least)), "h long, c long, pos int, doc_id long"))
    places = rows.where("pos >= 0").groupBy("h", "c", "pos").agg(F.min("doc_id").alias("doc_id"))
    often = rows.where("pos >= 0").groupBy("h").agg((F.min(_spot()) != F.max(_spot())).alias("places")).where("places").select("h")
    copied = rows.where("pos < 0").groupBy("h", "c", "pos").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1").drop("copies")
    copies = rows.where("pos < 0").join(copied, ["h", "c", "pos"])
    return written(places.join(often, "h").select("h", "c", "pos", "doc_id").union(copies.select("h", "c", "pos", "doc_id")))


def texts_with(docs: DataFrame, found: DataFrame) -> DataFrame:
    """(doc_id, text, c, pos array) of the documents that hold repeated anchors."""
    at = found.where("pos >= 0").groupBy("doc_id", "c").agg(F.sort_array(F.collect_set("pos")).alias("pos"))
    return prepared(docs).join(at.hint("shuffle_hash"), "doc_id")


def of_content(piece: pa.RecordBatch, w: tx.Words) -> Iterator[tuple[int, int, np.ndarray]]:
    """(row, content, repeated anchors) of the rows whose text is the content that the anchors are of."""
    cs, at = piece.column("c").to_numpy(), piece.column("pos")
    flat, off = at.flatten().to_numpy(), np.concatenate([[0], np.cumsum(at.value_lengths().to_numpy())])
    for i in range(piece.num_rows):
        if content(w.hash[w.first[i] : w.first[i + 1]])[0] == cs[i]:
            yield i, int(cs[i]), flat[off[i] : off[i + 1]]
