"""Exact nearest neighbours by pivot-table elimination.

Distances from every vector to a fixed number of pivots are computed once and stored beside the vectors, in blocks of
near ones. For a query and a candidate, the largest difference of their distances to a pivot is a lower bound of the
distance between them; each query goes through a block's candidates in the order of its own bounds until the bound
exceeds its k-th best distance. Ranges of pivot distances rule out whole blocks in the same way.

The queries are a stated part of the vectors. They are laid out in groups, the blocks in tiles, and each task takes
a group through the blocks of a tile, so a block is read once for a whole group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.llm._tables import partitions, written

_BLOCK = "block long, ids binary, vectors binary, pivots binary, low array<double>, high array<double>, asks binary, bound binary"
_PART = "kind int, block long, ids binary, vectors binary, pivots binary, low array<double>, high array<double>, bound binary"
_NEAR = "vec_id long, neighbour_id long, distance double"
_GROUP = 1 << 16  # queries that one task holds


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared Euclidean distances of all rows of a and b, by matrix product; off by rounding."""
    return np.maximum((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None] - 2 * (a @ b.T), 0)


def pivot_table(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """(pivots, vectors): distances to the pivots."""
    return np.stack([np.sqrt(((x - p) ** 2).sum(axis=1)) for p in pivots]) if len(x) else np.zeros((len(pivots), 0))


class Best:
    """The k nearest candidates of a query so far, by (distance, id), and the distance beyond which none is sought."""

    def __init__(self, k: int, bound: float = np.inf):
        self.k, self.bound = k, bound
        self.ids, self.dist = np.zeros(0, np.int64), np.zeros(0)

    def add(self, ids: np.ndarray, dist: np.ndarray) -> None:
        near = dist <= self.bound
        ids, dist = np.append(self.ids, ids[near]), np.append(self.dist, dist[near])
        order = np.lexsort((ids, dist))[: self.k]
        self.ids, self.dist = ids[order], dist[order]
        if len(self.ids) == self.k:
            self.bound = min(self.bound, float(self.dist[-1]))


def _slack(*tables: np.ndarray) -> float:
    """What a difference of distances in single precision may be off by."""
    return 1e-6 * max(float(np.abs(t).max(initial=0)) for t in tables)


def search(best: Best, me: int, q: np.ndarray, q_pivots: np.ndarray, ids: np.ndarray, x: np.ndarray, table: np.ndarray, step: int = 64) -> int:
    """Takes candidates into `best` in the order of their lower bounds, until the bound of the next one exceeds the
    k-th best distance; returns how many distances were computed. `me` isn't its own candidate."""
    low = np.zeros(len(ids), np.float32)
    for t, p in zip(table, q_pivots, strict=True):
        np.maximum(low, np.abs(t - np.float32(p)), out=low)
    low -= _slack(table, q_pivots)
    order = np.flatnonzero((low <= best.bound) & (ids != me))
    order = order[np.argsort(low[order], kind="stable")]
    low, at = low[order], 0
    while at < len(order) and low[at] <= best.bound:
        some = order[at : at + step]
        best.add(ids[some], np.sqrt(((x[some].astype(np.float64) - q) ** 2).sum(axis=1)))
        at, step = at + len(some), step * 2
    return at


def _cells(centres: np.ndarray):
    @F.arrow_udf("int")
    def of(x: pa.Array) -> pa.Array:
        v = x.flatten().to_numpy().astype(np.float64).reshape(len(x), -1)
        return pa.array(squares(v, centres).argmin(axis=1).astype(np.int32))

    return of


def _pack(pivots: np.ndarray, k: int, every: int, kind: str):
    """A block with its pivot table; asks are the rows that are queries, bound their k-th distance in the block."""

    def f(t: pa.Table) -> pa.Table:
        ids = t.column("vec_id").to_numpy()
        x = t.column("v").combine_chunks().flatten().to_numpy().astype(np.float64).reshape(len(ids), -1)
        exact = pivot_table(x, pivots)
        table, asks = exact.astype(np.float32), np.flatnonzero(ids % every == 0)
        bound = np.empty(len(asks))
        for i, a in enumerate(asks):
            best = Best(k)
            search(best, int(ids[a]), x[a], exact[:, a], ids, x, table)
            bound[i] = best.bound
        one = lambda v: pa.array([v.tobytes()], pa.binary())
        return pa.table({
            "block": pa.array([t.column("block")[0].as_py()], pa.int64()), "ids": one(ids), "vectors": one(x.astype(kind)), "pivots": one(table),
            "low": pa.array([exact.min(axis=1).tolist()]), "high": pa.array([exact.max(axis=1).tolist()]), "asks": one(asks), "bound": one(bound),
        })

    return f


def _read(r: dict, kind: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids = np.frombuffer(r["ids"], np.int64)
    return ids, np.frombuffer(r["vectors"], kind).reshape(len(ids), -1), np.frombuffer(r["pivots"], np.float32).reshape(-1, len(ids))


def _asked(kind: str):
    """The queries of each block."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                asks = np.frombuffer(r["asks"], np.int64)
                if len(asks):
                    ids, x, table = _read(r, kind)
                    cells = (0, r["block"], ids[asks].tobytes(), x[asks].tobytes(), table[:, asks].tobytes(), [], [], r["bound"])
                    kinds = (pa.int32(), pa.int64(), *[pa.binary()] * 3, *[pa.list_(pa.float64())] * 2, pa.binary())
                    names = [c.split(" ")[0] for c in _PART.split(", ")]
                    yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(cells, kinds, strict=True)], names=names)

    return f


def _searched(k: int, kind: str):
    """Rows of a task come sorted: first its queries, then its blocks."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, best = [], []
        for batch in batches:
            for i in range(batch.num_rows):
                r = batch.slice(i, 1).to_pylist()[0]
                if r["kind"] == 0:
                    parts.append((*_read(r, kind), np.frombuffer(r["bound"])))
                    continue
                if not parts:
                    return
                if not best:
                    q_ids, q, bound = (np.concatenate([p[c] for p in parts]) for c in (0, 1, 3))
                    q, q_table = q.astype(np.float64), np.concatenate([p[2] for p in parts], axis=1)
                    best = [Best(k, b) for b in bound]
                ids, x, table = _read(r, kind)
                low, high = np.array(r["low"])[:, None], np.array(r["high"])[:, None]
                gap = np.maximum(np.maximum(low - q_table, q_table - high), 0).max(axis=0)
                for j in np.flatnonzero(gap - _slack(table, q_table) <= np.array([b.bound for b in best])):
                    search(best[j], int(q_ids[j]), q[j], q_table[:, j], ids, x, table)
        if best:
            n = [len(b.ids) for b in best]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(q_ids, n)), pa.array(np.concatenate([b.ids for b in best])), pa.array(np.concatenate([b.dist for b in best]))], names=["vec_id", "neighbour_id", "distance"])

    return f


def _spread(sample: np.ndarray, count: int) -> np.ndarray:
    """Farthest-first choice of pivots."""
    out = [sample[0]]
    far = squares(sample, sample[:1])[:, 0]
    while len(out) < min(count, len(sample)) and far.max() > 0:
        out.append(sample[int(far.argmax())])
        far = np.minimum(far, squares(sample, out[-1][None])[:, 0])
    return np.array(out)


def top_k(vectors: DataFrame, k: int = 10, pivots: int = 32, block: int = 8192, sample: int = 4096, every: int = 1) -> DataFrame:
    """(vec_id, rank, neighbour_id, distance): the k nearest other vectors of every query, exactly. Queries are the
    vectors whose vec_id is divisible by `every`; candidates are all vectors.

    Takes vec_id and embedding. Distances are Euclidean, in double precision. Pivots, and the centres of blocks,
    come from the `sample` vectors of least hash; they change the speed alone.

    A null vec_id or embedding, and an embedding with a null, NaN or infinite element, takes no part; nor does an
    empty one, or one whose length isn't the most frequent one (of several, the longest). Equal distances are ranked by
    smaller neighbour_id. Repeated vec_ids: the least embedding counts. Fewer than k others: all of them. There are no
    texts here; very long embeddings are compared whole. No vectors, or no queries: no rows. Other columns are
    ignored, whatever their names.
    """
    spark = vectors.sparkSession
    v = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and v is not null and size(v) > 0")
    rows = rows.where(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    rows = rows.groupBy("vec_id").agg(F.min("v").alias("v"))
    sizes = rows.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    if sizes is None:
        return spark.createDataFrame([], "vec_id long, rank int, neighbour_id long, distance double")
    rows = rows.where(F.size("v") == sizes["dim"])
    some = np.array([r["v"] for r in rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).collect()])
    chosen = _spread(some, pivots)
    centres = some[: min(256, max(1, sizes["count"] // block))]
    cell = written(rows.withColumn("cell", _cells(centres)("v")))
    # a crowded cell is cut by hash; there are at most 256 cells, whose sizes are broadcast
    cuts = F.broadcast(cell.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / block).alias("cuts")))
    blocked = cell.join(cuts, "cell").select((F.col("cell") + 256 * F.pmod(F.xxhash64("vec_id"), F.col("cuts"))).cast("long").alias("block"), "vec_id", "v")
    kind = "float32" if isinstance(vectors.schema["embedding"].dataType.elementType, T.FloatType) else "float64"
    blocks = written(blocked.groupBy("block").applyInArrow(_pack(chosen, k, every, kind), _BLOCK))
    groups = max(1, -(-sizes["count"] // (every * _GROUP)))
    tiles = max(1, partitions(spark) // groups)
    spots = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    at = lambda n, salt: F.pmod(F.xxhash64("block", F.lit(salt)), F.lit(n)).cast("int")
    asks = blocks.mapInArrow(_asked(kind), _PART).withColumn("group", at(groups, 1)).withColumn("tile", spots(tiles))
    data = blocks.select(F.lit(1).alias("kind"), *[c.split(" ")[0] for c in _PART.split(", ")[1:]]).withColumn("tile", at(tiles, 2)).withColumn("group", spots(groups))
    both = asks.unionByName(data).withColumn("task", F.col("group") * tiles + F.col("tile"))
    met = both.repartitionById(groups * tiles, F.col("task")).sortWithinPartitions("kind", "block").drop("task", "group", "tile")
    near = met.mapInArrow(_searched(k, kind), _NEAR)
    rank = F.row_number().over(Window.partitionBy("vec_id").orderBy("distance", "neighbour_id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select("vec_id", "rank", "neighbour_id", "distance")
