"""Exact Jaccard join of documents by their word n-grams, as a join in the metric space of the Jaccard distance.

Documents with the same set of n-grams are one point. Pivots are documents: every n-gram belongs to the point of
the smallest digest that has it, so a point's n-grams fall to a few pivots, mostly itself and those that it is
near to. The n-grams that a point has from a pivot bound its overlap with everything else in that pivot's region:
a point is replicated into those regions only in which it can have a partner within the radius, the nearest
region first, and stays out of regions (of a passage that thousands of documents share, say) whose n-grams, with
all that follow, are too few. Inside a region the join is recursive: pivots from the region create Voronoi cells,
points within the triangle inequality's window of a cell are replicated into it, and cells of few points are
joined by counting. Every distance that is reported is exact.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm import _text as tx
from textloom.llm._lean import lean
from textloom.llm._tables import components, partitions, sieve, written

LEAF = 48
TILE = 2048  # members of a region that one task takes; of a larger one, each pair of tiles is a task
DENSE = 50  # pairs that a product of matrices counts in the time of one that is counted by itself
_SPLIT = 1 << 21
_CELLS = 1 << 21
_INDEX = "bucket int, x binary, counts binary, keys binary, doc_id binary, y binary"
_FOUND = "kind int, a long, b long, y long, n int"


def gram_sets(w: tx.Words, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(n-grams sorted within each text, where each text's begin, two digests of each text's set).

    A text of fewer than `size` words, but some, has one n-gram of all its words."""
    texts = len(w.first) - 1
    n = np.diff(w.first)
    g = np.zeros(len(w.hash), np.uint64)
    ok = np.arange(len(w.hash)) + size <= w.last()
    full = tx.grams(w.hash, size)
    g[: len(full)] = full
    for i in np.flatnonzero((n > 0) & (n < size)):
        g[w.first[i]] = tx.grams(w.hash[w.first[i] : w.first[i + 1]], int(n[i]))[0]
        ok[w.first[i]] = True
    doc, g = w.doc()[ok], g[ok]
    order = np.lexsort((g, doc))
    doc, g = doc[order], g[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (doc[1:] != doc[:-1])
    doc, g = doc[new], g[new]
    first = np.searchsorted(doc, np.arange(texts + 1))
    x, y = np.zeros(texts, np.uint64), np.zeros(texts, np.uint64)
    some = np.flatnonzero(np.diff(first))
    if len(some):
        x[some] = np.add.reduceat(tx.mix(g), first[some])
        y[some] = np.add.reduceat(tx.mix(g ^ tx.GRAM), first[some])
    return g, first, x, y


def _index(size: int, buckets: int):
    def rows(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        ids, x, y, n, g = (np.concatenate(c) for c in zip(*parts, strict=True))
        once = np.zeros(len(x), bool)
        once[np.unique(x, return_index=True)[1]] = True  # a set's n-grams go along once for all its copies here
        m, g = np.where(once, n, 0), g[np.repeat(once, n)]
        at, owner = (g % np.uint64(buckets)).astype(np.uint16 if buckets < 1 << 16 else np.int32), np.repeat(np.arange(len(m), dtype=np.int32), m)
        order = np.argsort(at, kind="stable")
        at, owner, keys = at[order], owner[order], (g[order] >> np.uint64(24)).astype(np.uint32)
        home = (np.where(n > 0, x, tx.mix(ids.astype(np.uint64))) % np.uint64(buckets)).astype(np.int64)
        out: list[list] = [[] for _ in range(6)]
        cut, mine = np.searchsorted(at, np.arange(buckets + 1)), np.argsort(home, kind="stable")
        cuts = np.searchsorted(home[mine], np.arange(buckets + 1))
        for b in range(buckets):
            o = owner[cut[b] : cut[b + 1]]
            m = mine[cuts[b] : cuts[b + 1]]
            new = np.flatnonzero(np.diff(o, prepend=-1))
            cols = (b, x[o[new]].tobytes(), np.diff(np.append(new, len(o))).astype(np.uint32).tobytes(), keys[cut[b] : cut[b + 1]].tobytes(),
                    ids[m].tobytes(), np.stack([x[m], y[m], n[m].astype(np.uint64)]).tobytes())
            for column, value in zip(out, cols, strict=True):
                column.append(value)
        kinds = (pa.int32(), *[pa.binary()] * 5)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=["bucket", "x", "counts", "keys", "doc_id", "y"])

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, ...]] = []
        held = 0
        for batch in batches:
            for piece in tx.pieces(batch, "text"):
                g, first, x, y = gram_sets(tx.scan(piece.column("text")), size)
                n = np.diff(first)
                ids = piece.column("doc_id").to_numpy()
                parts.append((ids, x, y, n, g))
                held += len(g)
                if held > _SPLIT:
                    yield rows(parts)
                    parts, held = [], 0
        if parts:
            yield rows(parts)

    return f


def _owners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For every point of a bucket, how many of its n-grams belong to each other point; and the points themselves."""
    names = ["kind", "a", "b", "y", "n"]
    held: dict[int, list[tuple[np.ndarray, ...]]] = {}
    for batch in batches:
        for r in batch.to_pylist():
            ids, (x, y, n) = np.frombuffer(r["doc_id"], np.int64), np.frombuffer(r["y"], np.uint64).reshape(3, -1)
            if len(ids):
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(ids), np.int32)), pa.array(ids), pa.array(tx.signed(x)), pa.array(tx.signed(y)), pa.array(n.astype(np.int32))], names=names)
            if r["keys"]:
                held.setdefault(r["bucket"], []).append((np.repeat(np.frombuffer(r["x"], np.uint64), np.frombuffer(r["counts"], np.uint32)), np.frombuffer(r["keys"], np.uint32)))
    for bucket in sorted(held):
        x, keys = (np.concatenate(c) for c in zip(*held.pop(bucket), strict=True))
        order = np.argsort(keys, kind="stable")
        keys, x = keys[order], x[order]
        same = keys[1:] == keys[:-1]
        shared = np.append(same, False) | np.append(False, same)
        keys, x = keys[shared], x[shared]
        order = np.lexsort((x, keys))
        keys, x = keys[order], x[order]
        first = np.append(True, keys[1:] != keys[:-1])[: len(keys)]
        once = first | np.append(True, x[1:] != x[:-1])[: len(keys)]  # copies of a set are one point
        keys, x, first = keys[once], x[once], first[once]
        owner = x[np.maximum.accumulate(np.where(first, np.arange(len(x)), 0))]
        other = owner != x
        a, b = x[other], owner[other]
        if not len(a):
            continue
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        new = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
        w = np.diff(np.append(new, len(a)))
        yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(new), np.int32)), pa.array(tx.signed(a[new])), pa.array(tx.signed(b[new])), pa.array(np.zeros(len(new), np.int64)), pa.array(w.astype(np.int32))], names=names)


def _overlaps(sets: list[np.ndarray], of: np.ndarray, with_: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of sets `of` with sets `with_`.

    N-grams that only one side has count for nothing and are left out. Of the others, those that few sets have are
    counted pair by pair, and those that many have by a product of matrices, whichever is less work."""
    out = np.zeros((len(of), len(with_)), np.float32)
    sides = []
    for at in (of, with_):
        g = np.concatenate([sets[k] for k in at])
        who = np.repeat(np.arange(len(at), dtype=np.int32), [len(sets[k]) for k in at])
        order = np.argsort(g, kind="stable")
        sides.append((g[order], who[order]))
    known = np.intersect1d(*(np.unique(g) for g, _ in sides), assume_unique=True)
    if not len(known):
        return out
    begin, times = ([np.searchsorted(g, known, side) for g, _ in sides] for side in ("left", "right"))
    times = [z - a for a, z in zip(begin, times, strict=True)]
    many = times[0] * times[1] > max(4, out.size // DENSE)
    few = np.flatnonzero(~many)
    # one entry for each n-gram of a row; it counts for all columns that have the n-gram
    n = times[0][few]
    entry = np.repeat(begin[0][few] - np.cumsum(n) + n, n) + np.arange(n.sum())
    row, first, width = sides[0][1][entry], np.repeat(begin[1][few], n), np.repeat(times[1][few], n)
    order = np.argsort(row, kind="stable")
    row, first, width = row[order], first[order], width[order]
    upto, rows, a = np.cumsum(width), max(1, _CELLS // len(with_)), 0
    while a < len(row):
        z = min(np.searchsorted(upto, (upto[a - 1] if a else 0) + _CELLS, "right"), np.searchsorted(row, row[a] + rows))
        z = max(int(z), a + 1)
        w = width[a:z]
        column = sides[1][1][np.repeat(first[a:z] - np.cumsum(w) + w, w) + np.arange(w.sum())]
        low, high = int(row[a]), int(row[z - 1]) + 1
        hits = np.bincount(np.repeat(row[a:z] - low, w).astype(np.int64) * len(with_) + column, minlength=(high - low) * len(with_))
        out[low:high] += hits.reshape(high - low, -1)
        a = z
    dense = np.flatnonzero(many)
    step = max(16, 2 * _CELLS // sum(out.shape))
    for a in range(0, len(dense), step):
        cols = dense[a : a + step]
        m = []
        for (_, who), b, t, size in zip(sides, begin, times, out.shape, strict=True):
            n = t[cols]
            table = np.zeros((size, len(cols)), np.float32)
            table[who[np.repeat(b[cols] - np.cumsum(n) + n, n) + np.arange(n.sum())], np.repeat(np.arange(len(cols)), n)] = 1
            m.append(table)
        out += m[0] @ m[1].T
    return out


def _close(sets: list[np.ndarray], least: float, side: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, similarity) of all pairs i < j of sets with a Jaccard similarity of `least` or more, recursively, each pair
    once, in blocks; with `side`, of pairs of a set where it is true with one where it is false."""
    size = np.array([len(s) for s in sets], np.float64)
    radius = 1 - least

    def brute(lead: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        at = at if side is None else at[~side[at]]
        step = max(64, _CELLS // max(1, len(at)))
        for k in range(0, len(lead) if len(at) else 0, step):
            rows = lead[k : k + step]
            both = _overlaps(sets, rows, at).astype(np.float64)
            j = both / (size[rows][:, None] + size[at][None] - both)
            a, b = np.nonzero(j >= least - 1e-12)
            if side is None:
                ordered = rows[a] < at[b]
                a, b = a[ordered], b[ordered]
            if len(a):
                yield np.minimum(rows[a], at[b]), np.maximum(rows[a], at[b]), j[a, b]

    def join(lead: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Pairs of which the first (with `side`, the true one) is in lead, and the other in at, that has lead's members too."""
        if len(at) <= LEAF:
            yield from brute(lead, at)
            return
        pivots = at[:: max(1, len(at) // max(2, len(at) // LEAF))]
        both = _overlaps(sets, at, pivots).astype(np.float64)
        d = 1 - both / (size[at][:, None] + size[pivots][None] - both)
        near = d.argmin(axis=1)
        own = d[np.arange(len(at)), near]
        leads, wide = np.isin(at, lead, assume_unique=True), np.zeros(len(at), bool)
        for c in range(len(pivots)):
            home = (near == c) & leads
            if not home.any():
                continue
            inside = home | (d[:, c] <= np.minimum(own + 2 * radius, d[home, c].max() + radius) + 1e-9)
            if inside.sum() > 0.7 * len(at):
                wide |= home
            else:
                yield from join(at[home], at[inside])
        yield from brute(at[wide], at)

    every = np.arange(len(sets))
    if len(sets) == 2:
        both = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        if both >= (least - 1e-12) * (size[0] + size[1] - both) and (side is None or side[0] != side[1]):
            yield every[:1], every[1:], both / (size[:1] + size[1:] - both)
        return
    g = np.concatenate(sets)
    order = np.argsort(g, kind="stable")
    same = g[order[1:]] == g[order[:-1]]
    shared = np.zeros(len(g), bool)
    shared[order] = np.append(same, False) | np.append(False, same)
    cut = np.cumsum(size).astype(np.int64)[:-1]  # n-grams of one set alone count by its size only
    sets = [s[k] for s, k in zip(sets, np.split(shared, cut), strict=True)]
    yield from join(every if side is None else every[side], every)


def metric_join(sets: list[np.ndarray], least: float) -> dict[tuple[int, int], float]:
    """All pairs i < j of sets with a Jaccard similarity of `least` or more."""
    return {(a, b): v for i, j, s in _close(sets, least) for a, b, v in zip(i.tolist(), j.tolist(), s.tolist(), strict=True)}


def _apart(before: list[list[int]]) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Whether the lists of i and of j have nothing in common."""
    n = Counter(p for b in before for p in set(b))
    known = {p: k for k, p in enumerate(sorted(p for p in n if n[p] > 1))}
    masks = np.zeros((-(-len(known) // 63), len(before)), np.int64)
    for k, b in enumerate(before):
        for at in {known[p] for p in b if p in known}:
            masks[at // 63, k] |= 1 << at % 63

    def f(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        out = np.ones(len(i), bool)
        for mask in masks:
            out &= mask[i] & mask[j] == 0
        return out

    return f


def _least(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """The least member of each one's connected component."""
    top = np.arange(n)
    while True:
        low = np.minimum(top[i], top[j])
        now = top.copy()
        np.minimum.at(now, top[i], low)
        np.minimum.at(now, top[j], low)
        now = now[now]
        if (now == top).all():
            return top
        top = now


def _regions(size: int, least: float, pairs: bool):
    """Rows come sorted by region and tiles. A pair counts in the first region that both are in, where their tiles
    meet. With `pairs`, rows are pairs (a, b, similarity); else each point's number of documents that it is linked
    to (a, null, n), and edges (a, b, null) that connect what the pairs connect."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, members = None, {}

        def sent(*out: np.ndarray) -> Iterator[pa.RecordBatch]:
            for a in range(0, len(out[0]), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(c[a : a + (1 << 16)]) for c in out], names=["a", "b", "v"])

        def done() -> Iterator[pa.RecordBatch]:
            keys = sorted(members)
            if len(keys) < 2:
                return
            doc_id, sets, tile, times, before = zip(*(members[k] for k in keys), strict=True)
            times, keys, every = np.array(times), np.array(keys, np.int64), np.arange(len(keys))
            apart = _apart(list(before))
            links, top = np.zeros(len(keys)), every
            for i, j, s in _close(list(sets), least, None if now[1] == now[2] else np.array(tile) == now[1]):
                own = apart(i, j)
                i, j, s = i[own], j[own], s[own]
                if pairs:
                    a, b = np.array(doc_id)[i], np.array(doc_id)[j]
                    yield from sent(np.minimum(a, b), np.maximum(a, b), s)
                else:
                    links += np.bincount(i, weights=times[j], minlength=len(keys)) + np.bincount(j, weights=times[i], minlength=len(keys))
                    top = _least(np.append(i, every), np.append(j, top), len(keys))
            some, away = np.flatnonzero(links), np.flatnonzero(top != every)
            yield from sent(np.append(keys[some], keys[away]), np.append(keys[some], keys[top[away]]), np.append(links[some], np.full(len(away), -1.0)))

        for batch in batches:
            for piece in tx.pieces(batch, "text"):
                g, first, x, _ = gram_sets(tx.scan(piece.column("text")), size)
                ids, want, region, low, high, tile, times = (piece.column(c).to_numpy() for c in ("doc_id", "x", "p", "t", "u", "tile", "times"))
                right, before = tx.signed(x) == want, piece.column("before").to_pylist()
                for i in range(piece.num_rows):
                    at = (region[i], low[i], high[i])
                    if at != now:
                        yield from done()
                        now, members = at, {}
                    if right[i]:
                        members[int(want[i])] = (int(ids[i]), g[first[i] : first[i + 1]], int(tile[i]), int(times[i]), before[i])
        yield from done()

    return f


def _joined(docs: DataFrame, size: int, least: float, pairs: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents with their sets' digest x, y and size n; points with their least doc_id and number of documents
    `times`; what _regions finds)."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    parts = partitions(spark)
    index = rows.mapInArrow(lean(_index(size, parts)), _INDEX).repartitionById(parts, F.col("bucket"))
    found = written(index.mapInArrow(lean(_owners), _FOUND))
    known = found.where("kind = 0").select(F.col("a").alias("doc_id"), F.col("b").alias("x"), "y", "n").distinct()
    points = known.where("n > 0").groupBy("x", "y", "n").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("times"))
    edges = written(found.where("kind = 1").groupBy(F.col("a").alias("x"), F.col("b").alias("p")).agg(F.sum("n").alias("w")))
    own = edges.groupBy("x").agg(F.sum("w").alias("w")).union(edges.select(F.col("p").alias("x"), F.lit(0).cast("long"))).groupBy("x").agg(F.sum("w").alias("w"))
    own = own.join(points.select("x", "n", "doc_id", "times"), "x")
    shares = edges.join(own.drop("w"), "x").select("x", "p", "w", "n", "doc_id", "times")
    shares = shares.union(own.select("x", F.col("x").alias("p"), F.col("n") - F.col("w"), "n", "doc_id", "times"))
    # Regions that hold most of a member's n-grams come first, by the mean share of the members weighted by shares;
    # passages that many share, and n-grams met by chance, come last. Integers, so that every task ranks alike. Shares
    # of regions that nobody else is in can't be in common, so they count as spent; so does what a share has above the
    # second largest of its region, as no other member has it.
    part = F.when(F.col("x") == F.col("p"), 0).otherwise(F.floor(F.col("w") * 1000000 / F.col("n"))).cast("long")
    sized = shares.withColumn("part", part)
    region = sized.groupBy("p").agg(F.max("w").alias("m"), F.sum(F.col("part") * F.col("part")).alias("s2"), F.sum("part").alias("s1"), F.count(F.lit(1)).alias("k"))
    rest = shares.join(region.where("k > 1").select("p", "m", F.expr("s2 div greatest(1L, s1)").alias("rank")), "p")
    second = rest.groupBy("p").agg(F.when(F.count_if(F.col("w") == F.col("m")) > 1, F.max("m")).otherwise(F.max(F.when(F.col("w") < F.col("m"), F.col("w")))).alias("second"))
    ranked = rest.join(second.where("second > 0"), "p").withColumn("w", F.least("w", "second")).drop("second", "m")
    order = Window.partitionBy("x").orderBy("rank", "p")
    suffix = F.sum("w").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    inside = written(ranked.withColumn("left", suffix).where(F.col("left") >= F.ceil(F.lit(least) * F.col("n") - 1e-9)).select("doc_id", "x", "p", "rank", "times"))
    crowd = inside.groupBy("p").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("p", F.ceil(F.col("k") / TILE).cast("int").alias("tiles"))
    members = inside.join(crowd, "p").withColumn("tile", F.pmod(F.xxhash64("x"), F.col("tiles")).cast("int"))
    members = members.withColumn("before", F.collect_list("p").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    members = members.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    members = written(members.select("doc_id", "x", "p", "tile", "times", "before", F.least("tile", "o").alias("t"), F.greatest("tile", "o").alias("u")))
    maybe = sieve(members.select("doc_id"))
    placed = rows.where(maybe("doc_id")).join(members.hint("shuffle_hash"), "doc_id")
    kinds = "a long, b long, v double"
    return known, points, placed.repartition(parts, "p", "t", "u").sortWithinPartitions("p", "t", "u", "x").mapInArrow(lean(_regions(size, least, pairs)), kinds)


def similar_pairs(docs: DataFrame, size: int = 5, least: float = 0.4) -> DataFrame:
    """(doc_a, doc_b, jaccard): the exact join of documents whose sets of `size`-word n-grams have a Jaccard
    similarity of `least` or more.

    Documents of the same set stand for one another: the smallest doc_id of each set is joined with those of
    other sets (doc_a < doc_b), and with each further document of its own set at similarity 1. Words are those of
    _text; a text of fewer words than `size` is one n-gram.

    Null, empty and wordless texts have no n-grams and no partner. A null doc_id takes no part. Repeated rows
    count once; rows that share a doc_id and differ in text are separate documents. Very long texts count whole. Ties
    don't arise: all pairs are reported, without caps. No documents: no rows. Other columns are ignored, whatever
    their names.
    """
    known, points, found = _joined(docs, size, least, True)
    joined = found.select(F.col("a").alias("doc_a"), F.col("b").alias("doc_b"), F.col("v").alias("jaccard"))
    copies = known.join(points.withColumnRenamed("doc_id", "doc_a"), ["x", "y", "n"]).where("doc_id > doc_a").select("doc_a", F.col("doc_id").alias("doc_b"), F.lit(1.0).alias("jaccard"))
    return joined.union(copies)


def similar_classes(docs: DataFrame, size: int = 5, least: float = 0.4) -> DataFrame:
    """(doc_id, class_id, n_links) for every document: the exact join of similar_pairs(), without its pairs.

    Documents whose sets of `size`-word n-grams have a Jaccard similarity of `least` or more are linked; n_links
    counts all other documents that a document is linked to, those of the same set included. class_id is the
    smallest doc_id of those that links connect.

    Null, empty and wordless texts, and documents without a link, are classes of their own with 0 links. A null
    doc_id takes no part. Repeated rows count once, so do rows of the same doc_id and set; rows that share a doc_id
    and have different sets are separate documents. Very long texts count whole. Ties don't arise. No documents: no
    rows. Other columns are ignored, whatever their names.
    """
    known, points, found = _joined(docs, size, least, False)
    found = written(found)
    links = found.where("v > 0").groupBy(F.col("a").alias("x")).agg(F.sum("v").cast("long").alias("links"))
    groups = components(found.where("v < 0")).withColumnRenamed("node", "x")
    firsts = groups.join(points.select("x", "doc_id"), "x").groupBy("component").agg(F.min("doc_id").alias("class_id"))
    of = points.select("x", "y", "n", F.col("doc_id").alias("first"), "times").join(links, "x", "left").join(groups, "x", "left").join(firsts, "component", "left")
    of = of.select("x", "y", "n", F.coalesce("class_id", "first").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("times") - 1).alias("n_links"))
    alone = known.where("n = 0").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return known.where("n > 0").join(of, ["x", "y", "n"]).select("doc_id", "class_id", "n_links").union(alone)


def without_similar(docs: DataFrame, size: int = 5, least: float = 0.4) -> DataFrame:
    """docs without the documents that are linked, as similar_classes() links them, to one of smaller doc_id; all
    columns. Rows that share the doc_id which stays are that document, and all stay, as do rows of null doc_id, and
    of null, empty and wordless texts. No documents: no rows. Other columns come along, whatever their names."""
    known, points, found = _joined(docs, size, least, False)
    edges = written(found.where("v < 0"))
    first = points.select("x", "y", "n", F.col("doc_id").alias("to"))
    ends = edges.join(first.select(F.col("x").alias("a"), F.col("to").alias("u")), "a").join(first.select(F.col("x").alias("b"), F.col("to").alias("v_")), "b").select(F.col("u").alias("a"), F.col("v_").alias("b"))
    ends = ends.union(known.join(first, ["x", "y", "n"]).where("doc_id > to").select(F.col("doc_id").alias("a"), F.col("to").alias("b")))
    gone = written(components(ends).where("node <> component").select(F.col("node").alias("_gone_")).distinct())
    maybe = F.coalesce(sieve(gone.select(F.col("_gone_").alias("doc_id")))(F.col("doc_id").cast("long")), F.lit(False))
    held = docs.where(maybe).select(F.struct("*").alias("_row_"), F.col("doc_id").cast("long").alias("_id_"))
    return docs.where(~maybe).union(held.join(gone, F.col("_id_") == F.col("_gone_"), "left_anti").select("_row_.*"))
