"""Suffix-array dedup by column-wise construction.

The collection's Burrows-Wheeler transform and the common prefixes of neighbouring suffixes grow by one symbol
of every piece a round (Bauer, Cox and Rosone). Window starts are routed by their anchor, which equal windows
share, so the suffixes of an anchor, or of several, are a collection of their own and no neighbour is missed. All pieces
of an anchor hold it, and no window begins behind it, so it is one symbol that counts as its words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm import _text as tx
from textloom.llm._lean import lean
from textloom.llm._anchors import of_content, repeated, size_of, texts_with, windows
from textloom.llm._tables import partitions

_LOW = np.uint64(0xFFFFFFFF)
_BLOCK = 512
LOT = 1 << 12  # pieces of a collection, unless an anchor has more: what a round goes through stays in the processor's caches


def _range_min(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least of x[a..b], both included, a <= b."""
    def cut(v: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        at = np.empty(2 * len(i), np.int64)
        at[::2], at[1::2] = i, j
        return np.minimum.reduceat(np.append(v, np.iinfo(v.dtype).max), at)[::2]

    out = np.empty(len(a), x.dtype)
    near = b - a < 2 * _BLOCK
    if near.any():
        out[near] = cut(x, a[near], b[near] + 1)
    if not near.all():
        far = ~near
        i, j = a[far], b[far] + 1
        p, q = -(-i // _BLOCK), j // _BLOCK
        blocks = np.minimum.reduceat(x, np.arange(0, len(x), _BLOCK))
        low = cut(blocks, p, q)
        left, right = i < p * _BLOCK, q * _BLOCK < j
        low[left] = np.minimum(low[left], cut(x, i[left], p[left] * _BLOCK))
        low[right] = np.minimum(low[right], cut(x, q[right] * _BLOCK, j[right]))
        out[far] = low
    return out


def collection_arrays(symbols: np.ndarray, length: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order of a collection of pieces, that lie end to end in symbols.

    Returns (place, lcp): place[j] is, for the symbol at j, the rank of the suffix from there to its piece's end
    among all suffixes, behind the pieces' empty suffixes; lcp[r] is the common prefix of ranks r - 1 and r, in which
    symbol s counts weight[s], or 1. Symbols are below 2**31. Round j inserts the suffix of length j + 1 of every piece that has one: its rank
    follows from the rank of the suffix after it, as keys (symbol, that rank) are kept sorted; keys hold the
    transform by first symbol, and each round merges the new ones in, in one pass.
    """
    m, end = len(length), np.cumsum(length)
    keys, lcp, pos = np.zeros(0, np.uint64), np.zeros(m, np.int32), np.arange(m, dtype=np.int64)
    by_length = np.argsort(-length, kind="stable")
    longest = int(length.max()) if m else 0
    for j in range(longest):
        act = by_length[: np.searchsorted(-length[by_length], -j, side="left")]
        new = (symbols[end[act] - 1 - j].astype(np.uint64) << np.uint64(32)) | pos[act].astype(np.uint64)
        order = np.argsort(new)
        new, act = new[order], act[order]
        ins = np.searchsorted(keys, new) + np.arange(len(new))
        old = np.ones(len(keys) + len(new), bool)
        old[ins] = False
        merged = np.empty(len(old), np.uint64)
        merged[ins], merged[old] = new, keys
        common = np.zeros(len(old), np.int32)
        common[old] = lcp[m:]
        touched = np.zeros(len(old) + 1, bool)
        touched[ins], touched[ins + 1], touched[0] = True, True, False
        at = np.flatnonzero(touched[:-1])
        common[ins[ins == 0]] = 0
        same = (merged[at] >> np.uint64(32)) == (merged[at - 1] >> np.uint64(32))
        common[at[~same]] = 0
        at = at[same]
        if len(at):
            a, b = (merged[at - 1] & _LOW).astype(np.int64), (merged[at] & _LOW).astype(np.int64)
            common[at] = _range_min(lcp, a + 1, b) + (1 if weight is None else weight[(merged[at] >> np.uint64(32)).astype(np.int64)])
        moved = np.concatenate([np.arange(m), m + np.flatnonzero(old)]).astype(np.uint64)
        keys = (merged & ~_LOW) | moved[(merged & _LOW).astype(np.int64)]
        lcp = np.concatenate([np.zeros(m, np.int32), common])
        pos[act] = m + ins
    after = np.full(m + len(keys), -1, np.int64)
    after[(keys & _LOW).astype(np.int64)] = m + np.arange(len(keys))
    place, now = np.empty(len(symbols), np.int64), np.arange(m, dtype=np.int64)
    for j in range(longest):
        act = by_length[: np.searchsorted(-length[by_length], -j, side="left")]
        now[act] = after[now[act]]
        place[end[act] - 1 - j] = now[act]
    return place, lcp


def _pieces(least: int):
    k = size_of(least)[0]

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in tx.pieces(batch, "text"):
                ids, w = piece.column("doc_id").to_numpy(), tx.scan(piece.column("text"))
                g, start, at = windows(w, least)
                hs, ds, cs, ss, ls, bs = [], [], [], [], [], []
                bounds = np.searchsorted(start, w.first)
                for i, c, anchors in of_content(piece, w):
                    p, q = bounds[i], bounds[i + 1]
                    s, a = start[p:q], at[p:q]
                    first = np.flatnonzero(np.diff(a, prepend=-1))
                    last = np.append(first[1:], len(a))
                    for x, y in zip(first[hit := np.isin(a[first] - w.first[i], anchors)].tolist(), last[hit].tolist(), strict=True):
                        hs.append(g[a[x]])
                        ds.append(ids[i])
                        cs.append(c)
                        ss.append(s[x] - w.first[i])
                        ls.append(a[x] - s[x])
                        bs.append(w.hash[s[x] : a[x]].tobytes() + w.hash[a[x] + k : s[y - 1] + least].tobytes())
                if hs:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(tx.signed(np.array(hs, np.uint64))), pa.array(ds, pa.int64()), pa.array(cs, pa.int64()), pa.array(ss, pa.int32()), pa.array(ls, pa.int32()), pa.array(bs, pa.binary())],
                        names=["h", "doc_id", "c", "start", "lead", "words"],
                    )

    return f


def _lots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows come sorted by anchor: LOT of them or more at a time, never an anchor's rows apart."""
    held, rows, now = [], 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        h, at = batch.column("h").to_numpy(), 0
        for x in np.flatnonzero(np.append(now != h[0], h[1:] != h[:-1])).tolist():
            if rows + x - at >= LOT:
                yield pa.Table.from_batches([*held, batch.slice(at, x - at)])
                held, rows, at = [], 0, x
        held.append(batch.slice(at))
        rows, now = rows + batch.num_rows - at, h[-1]
    if held:
        yield pa.Table.from_batches(held)


def _neighbours(least: int):
    k = size_of(least)[0]

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lot in _lots(batches):
            h, ids, cs, starts, lead = (lot.column(c).to_numpy() for c in ("h", "doc_id", "c", "start", "lead"))
            known: dict[tuple[int, int, bytes], int] = {}
            which = np.fromiter((known.setdefault(x, len(known)) for x in zip(h.tolist(), lead.tolist(), lot.column("words").to_pylist(), strict=True)), np.int64, len(h))
            anchor, before, words = zip(*known, strict=True)
            size = np.fromiter((len(b) // 8 for b in words), np.int64, len(words))
            names, symbols = np.unique(np.frombuffer(b"".join(words), np.uint64), return_inverse=True)
            anchors, anchor = np.unique(np.array(anchor, np.int64), return_inverse=True)
            symbols = np.insert(symbols, np.cumsum(size) - size + np.array(before, np.int64), len(names) + anchor)
            length = size + 1
            place, lcp = collection_arrays(symbols, length, np.repeat(np.array([1, k], np.int32), [len(names), len(anchors)]))
            shared = np.maximum(lcp, np.append(lcp[1:], 0))[place]
            # window starts that another place has too, and their runs in each piece; a gap behind each piece
            first, piece = np.cumsum(length) - length, np.repeat(np.arange(len(length)), length)
            window = np.arange(len(symbols)) - first[piece] < (length + k - least)[piece]
            flags = np.zeros(len(symbols) + len(length), bool)
            flags[np.arange(len(symbols)) + piece] = window & ((shared >= least) | (np.bincount(which) > 1)[piece])
            s, e = tx.runs(flags)
            first += np.arange(len(length))
            of = np.searchsorted(first, s, side="right") - 1
            runs = np.bincount(of, minlength=len(length))
            each = runs[which]
            row = np.repeat(np.arange(len(which)), each)
            run = (np.cumsum(runs) - runs)[which[row]] + np.arange(len(row)) - np.repeat(np.cumsum(each) - each, each)
            base = starts[row] - first[of[run]]
            if len(row):
                yield pa.RecordBatch.from_arrays([pa.array(ids[row]), pa.array(cs[row]), pa.array((base + s[run]).astype(np.int32)), pa.array((base + e[run] - 1 + least).astype(np.int32))], names=["doc_id", "c", "start", "end"])

    return f


def _join(least: int):
    """Rows come sorted by document and start: stretches whose window starts touch become one."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: tuple | None = None
        for batch in batches:
            out = []
            for d, c, s, e in zip(*(batch.column(x).to_pylist() for x in ("doc_id", "c", "start", "end")), strict=True):
                if now and now[:2] == (d, c) and s <= now[3] - least + 1:
                    now = (d, c, now[2], max(e, now[3]))
                else:
                    if now:
                        out.append(now)
                    now = (d, c, s, e)
            if out:
                d, _, s, e = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(s, pa.int32()), pa.array(e, pa.int32())], names=["doc_id", "start_word", "end_word"])
        if now:
            yield pa.RecordBatch.from_arrays([pa.array([now[0]], pa.int64()), pa.array([now[2]], pa.int32()), pa.array([now[3]], pa.int32())], names=["doc_id", "start_word", "end_word"])

    return f


def suffix_repeats(docs: DataFrame, least: int = 50) -> DataFrame:
    """Every stretch of a document whose windows of `least` words occur elsewhere in the corpus.

    Takes doc_id and text of docs, whatever else it has. Returns (doc_id, start_word, end_word): a window start
    belongs to a stretch if its suffix shares `least` words or more with a neighbour in suffix order; a document
    with another copy (the same words) is one stretch.

    Null doc_id: the row takes no part. Null or empty text, and texts shorter than `least` words: no stretch.
    Repeated rows, and documents with the same words, are copies of each other. Rows that share a doc_id and
    differ in text are separate documents. Very long texts count whole. Ties don't arise. No documents: no rows.
    """
    found = repeated(docs, least)
    copies = found.where("pos < 0").select("doc_id", "c", F.lit(0).alias("start_word"), (-F.col("pos")).alias("end_word")).distinct()
    pieces = texts_with(docs, found).mapInArrow(lean(_pieces(least)), "h long, doc_id long, c long, start int, lead int, words binary")
    spread = pieces.repartition(partitions(docs.sparkSession), "h").sortWithinPartitions("h")
    rows = spread.mapInArrow(lean(_neighbours(least)), "doc_id long, c long, start int, end int")
    rows = rows.join(copies.select("doc_id", "c"), ["doc_id", "c"], "left_anti")
    parts = rows.repartition("doc_id", "c").sortWithinPartitions("doc_id", "c", "start").mapInArrow(lean(_join(least)), "doc_id long, start_word int, end_word int")
    return parts.union(copies.select("doc_id", "start_word", "end_word"))
