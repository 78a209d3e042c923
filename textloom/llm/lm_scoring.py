"""Masked pseudo-likelihood by a bidirectional window network.

The network sees the words on both sides of a masked word and predicts it: position-wise embeddings of the
neighbours are summed and squashed, and a two-level softmax gives the word's class and the word in it. It is
trained by data-parallel passes over the whole corpus, which together mask every word: every task walks through its
documents with Adagrad on a pass's words, and the tasks' parameters are averaged, weighted by the words they saw.

The most frequent words have numbers of their own. The others share numbers, and such a word's probability is its
number's times its part of what the number counts in the corpus, so that all words of the corpus add up to 1.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm import _text as tx
from textloom.llm._lean import lean
from textloom.llm._tables import partitions, written

CLASSES, MEMBERS = 64, 64
V = CLASSES * MEMBERS
KNOWN = V // 2  # words with a number of their own; the others share the rest by hash
PAD = V
SIDE = 2
DIM = 32
_SHAPES = {"e": (2 * SIDE, V + 1, DIM), "b": (DIM,), "c": (DIM, CLASSES), "cb": (CLASSES,), "m": (CLASSES, DIM, MEMBERS), "mb": (CLASSES, MEMBERS)}
_BATCH = 1 << 13  # words of a step
_SLICE = 1 << 15
_BITS = 13  # by which known words are looked up
_SHIFT = np.uint64(64 - _BITS)
_CHUNK = 1 << 20  # words without a number of their own that a task holds
_PARTIAL = "chunk string, bucket int, doc_id array<long>, n array<long>, total array<double>, doc binary, code binary, words binary, counts binary"
_KINDS = (pa.string(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.float64()), *[pa.binary()] * 4)
Params = dict[str, np.ndarray]


def initial(seed: int, often: np.ndarray) -> Params:
    """Random weights; the biases give every word number its share of the corpus."""
    rng = np.random.default_rng(seed)
    scale = {"e": 0.3, "b": 0.0, "c": 0.1, "cb": 0.0, "m": 0.1, "mb": 0.0}
    p = {k: (scale[k] * rng.standard_normal(s)).astype(np.float32) for k, s in _SHAPES.items()}
    share = (often + 0.5).reshape(MEMBERS, CLASSES).T
    p["cb"] += np.log(share.sum(axis=1) / share.sum()).astype(np.float32)
    p["mb"] += np.log(share / share.sum(axis=1, keepdims=True)).astype(np.float32)
    return p


def flat(p: Params) -> np.ndarray:
    return np.concatenate([p[k].ravel() for k in _SHAPES])


def unflat(x: np.ndarray) -> Params:
    out, at = {}, 0
    for k, s in _SHAPES.items():
        n = int(np.prod(s))
        out[k] = x[at : at + n].reshape(s).astype(np.float32)
        at += n
    return out


def numbers(hashes: np.ndarray, known: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Word numbers: place[i] for known[i] (sorted hashes), a hashed one of the upper half for the others."""
    out = KNOWN + (hashes % np.uint64(V - KNOWN)).astype(np.int64)
    if not len(known):
        return out
    # known ones by their first bits; the few that have them in common with others come in further turns
    first = np.searchsorted(known >> _SHIFT, np.arange((1 << _BITS) + 1, dtype=np.uint64))
    at = first.take((hashes >> _SHIFT).astype(np.int64))
    for turn in range(int(np.diff(first).max())):
        hit = np.flatnonzero(known.take(at + turn, mode="clip") == hashes)
        out[hit] = place.take(at[hit] + turn, mode="clip")
    return out


def contexts(ids: np.ndarray, w: tx.Words, at: np.ndarray) -> np.ndarray:
    """(2 * SIDE, len(at)): the numbers of the words before and after the words `at` in their text, PAD beyond its ends."""
    n = np.diff(w.first)
    first, last = np.repeat(w.first[:-1], n)[at], np.repeat(w.first[1:], n)[at]
    out = np.full((2 * SIDE, len(at)), PAD, np.int64)
    for row, k in zip(out, [*range(-SIDE, 0), *range(1, SIDE + 1)], strict=True):
        ok = np.flatnonzero((at + k >= first) & (at + k < last))
        row[ok] = ids[at[ok] + k]
    return out


def _hidden(p: Params, ctx: np.ndarray) -> np.ndarray:
    h = p["e"][0].take(ctx[0], axis=0, mode="clip")
    h += p["b"]
    for e, at in zip(p["e"][1:], ctx[1:], strict=True):
        h += e.take(at, axis=0, mode="clip")
    return np.tanh(h, out=h)


def _with_ones(h: np.ndarray) -> np.ndarray:
    """h and a last column of ones, by which biases are weights like others."""
    out = np.ones((len(h), h.shape[1] + 1), np.float32)
    out[:, :-1] = h
    return out


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.matmul(a, b, out=_matrix(len(a), b.shape[1]))


def _matrix(rows: int, n: int) -> np.ndarray:
    """Rows that lie a little apart, as those whose distance is a power of two drive one another out of the caches."""
    return np.empty((rows, n + 16), np.float32)[:, :n]


def _biased(p: Params) -> tuple[np.ndarray, np.ndarray]:
    """Weights of classes and of the words in each, with the biases as a last row."""
    return np.concatenate([p["c"], p["cb"][None]]), np.concatenate([p["m"], p["mb"][:, None]], axis=1)


def _members(m: np.ndarray, h: np.ndarray, cls: np.ndarray) -> tuple[np.ndarray, list[tuple[int, slice]]]:
    """(logits of the words within the class of each column, which are sorted by class; the columns of each class)."""
    cuts = np.searchsorted(cls, np.arange(CLASSES + 1)).tolist()
    spans = [(c, slice(a, z)) for c, (a, z) in enumerate(zip(cuts, cuts[1:], strict=False)) if z > a]
    x = _matrix(MEMBERS, len(h))
    for c, z in spans:
        np.matmul(m[c].T, h[z].T, out=x[:, z])
    return x, spans


def _softmax(x: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(log-probability of the target, what its mean over the columns takes from each logit's gradient), columns of x,
    so that maxima are taken of whole rows; x is overwritten."""
    n, at = len(target), np.arange(len(target))
    x -= x.max(axis=0)
    hit = x[target, at]
    np.exp(x, out=x)
    z = _ones(len(x)) @ x
    x *= np.float32(1 / n) / z
    x[target, at] -= np.float32(1 / n)
    return hit - np.log(z), x


def log_probs(p: Params, ctx: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The log-probability of each target between its neighbours."""
    out = np.empty(len(target), np.float32)
    classes, words = _biased(p)
    for a in range(0, len(target), _BATCH):
        order = a + np.argsort((target[a : a + _BATCH] % CLASSES).astype(np.int16), kind="stable")
        t = target[order]
        cls, member = t % CLASSES, t // CLASSES
        h = _with_ones(_hidden(p, ctx[:, order]))
        lp = _lse(_product(classes.T, h.T), cls)
        lp += _lse(_members(words, h, cls)[0], member)
        out[order] = lp
    return out


def _lse(x: np.ndarray, target: np.ndarray) -> np.ndarray:
    x -= x.max(axis=0)
    hit = x[target, np.arange(len(target))]
    np.exp(x, out=x)
    return hit - np.log(_ones(len(x)) @ x)


def _ones(n: int) -> np.ndarray:
    return np.ones(n, np.float32)


class Adagrad:
    def __init__(self, p: Params, rate: float):
        self.p, self.rate = p, rate
        self.s = {k: np.full(v.shape, 1e-4, np.float32) for k, v in p.items()}

    def dense(self, k: str, grad: np.ndarray, at=slice(None)) -> None:
        p, s = self.p[k][at], self.s[k][at]
        by = grad * grad
        s += by
        np.sqrt(s, out=by)
        np.divide(grad, by, out=by)
        by *= self.rate
        p -= by

    def step(self, ctx: np.ndarray, target: np.ndarray) -> float:
        """One step on a batch; returns the mean log-probability before it."""
        p, n = self.p, len(target)
        order = np.argsort((target % CLASSES).astype(np.int16), kind="stable")  # words of a class lie together
        ctx, target = ctx[:, order], target[order]
        cls, member = target % CLASSES, target // CLASSES
        classes, words = _biased(p)
        h = _hidden(p, ctx)
        h1 = _with_ones(h)
        lp, q = _softmax(_product(classes.T, h1.T), cls)
        total = float(lp.sum())
        dh = q.T @ p["c"].T
        grad = (q @ h1).T
        self.dense("c", grad[:-1])
        self.dense("cb", grad[-1])
        x, spans = _members(words, h1, cls)  # all classes' words in one array, so that one softmax and one update do
        lp, q = _softmax(x, member)
        total += float(lp.sum())
        grad, part = np.zeros((CLASSES, MEMBERS, DIM + 1), np.float32), np.empty_like(dh)
        for c, z in spans:
            np.matmul(q[:, z].T, p["m"][c].T, out=part[z])
            np.matmul(q[:, z], h1[z], out=grad[c])
        dh += part
        self.dense("m", np.ascontiguousarray(grad[:, :, :-1].transpose(0, 2, 1)))
        self.dense("mb", grad[:, :, -1])
        dh *= 1 - h * h
        self.dense("b", dh.sum(axis=0))
        pairs = np.ascontiguousarray(dh.view(np.complex64).T)  # two dimensions are summed at once
        for k in range(len(ctx)):
            grad = np.zeros((DIM // 2, V + 1), np.complex64)
            for sums, values in zip(grad, pairs, strict=True):  # they lie in the first cache
                np.add.at(sums, ctx[k], values)
            self.dense("e", np.ascontiguousarray(grad.T).view(np.float32), k)
        return total / n


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words and their counts; written out whenever many are held."""
    held, size = [], 0

    def rows() -> pa.RecordBatch:
        h, at = np.unique(np.concatenate([x for x, _ in held]), return_inverse=True)
        n = np.bincount(at, weights=np.concatenate([c for _, c in held])).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(tx.signed(h)), pa.array(n)], names=["h", "n"])

    for batch in batches:
        for piece in tx.pieces(batch, "text"):
            held.append(np.unique(tx.scan(piece.column("text")).hash, return_counts=True))
            size += len(held[-1][0])
            if size > 1 << 21:
                yield rows()
                held, size = [], 0
    if size:
        yield rows()


def _read(piece: pa.RecordBatch, known: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, tx.Words]:
    w = tx.scan(piece.column("text"))
    return numbers(w.hash, known, place), w


def _trained(sent, every: int, turn: int, rate: float, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    start, known, place = sent.value
    net = Adagrad(unflat(start), rate)
    seen, ctx, target = 0, [], []
    for batch in batches:
        for piece in tx.pieces(batch, "text"):
            ids, w = _read(piece, known, place)
            # masked words: every `every`-th by a hash of the word and its place
            mask = np.flatnonzero(tx.mix(w.hash + np.arange(len(ids), dtype=np.uint64) * tx.GRAM) % np.uint64(every) == turn)
            ctx.append(contexts(ids, w, mask))
            target.append(ids[mask])
            seen += len(mask)
            if sum(map(len, target)) >= _BATCH:
                x, t = np.concatenate(ctx, axis=1), np.concatenate(target)
                for a in range(0, len(t), _BATCH):
                    net.step(x[:, a : a + _BATCH], t[a : a + _BATCH])
                ctx, target = [], []
    if sum(map(len, target)):
        net.step(np.concatenate(ctx, axis=1), np.concatenate(target))
    if seen:
        x = flat(net.p)
        cuts = range(0, len(x), _SLICE)
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(len(cuts)), pa.int32()), pa.array([x[a : a + _SLICE].astype(np.float32).tobytes() for a in cuts], pa.binary()), pa.array([float(seen)] * len(cuts))], names=["part", "x", "n"]
        )


def _averaged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, list] = {}
    for batch in batches:
        for part, x, n in zip(*(batch.column(c).to_pylist() for c in ("part", "x", "n")), strict=True):
            t = total.setdefault(part, [0.0, 0.0])
            t[0] = t[0] + np.frombuffer(x, np.float32).astype(np.float64) * n
            t[1] += n
    if total:
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([(s / n).astype(np.float32).tobytes() for s, n in total.values()], pa.binary())], names=["part", "x"])


def _scored(sent, buckets: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents in chunks: of each, the sum without the counts of words that share a number, and where such words
    are; and the chunk's distinct words of this kind with their counts, by ranges of hashes."""
    x, known, place, often = sent.value
    p, part = unflat(x), TaskContext.get().partitionId()
    log = np.log(np.maximum(often, 1))
    held: list[tuple] = []
    size = chunks = 0

    def rows() -> pa.RecordBatch:
        ids, n, total, doc, words = zip(*held, strict=True)
        base = np.cumsum([0, *map(len, n)])
        name, code, count = np.unique(np.concatenate(words), return_inverse=True, return_counts=True)
        chunk, bucket = f"{part}-{chunks}", ((name >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
        doc = np.concatenate([d + k for d, k in zip(doc, base, strict=False)])
        out = [(chunk, None, sum(ids, []), np.concatenate(n).tolist(), np.concatenate(total).tolist(), doc.astype(np.int32).tobytes(), code.astype(np.int32).tobytes(), None, None)]
        cut = np.searchsorted(bucket, np.arange(buckets + 1))
        for k in np.flatnonzero(np.diff(cut)):
            z = slice(cut[k], cut[k + 1])
            out.append((chunk, int(k), None, None, None, None, None, name[z].tobytes(), count[z].astype(np.int64).tobytes()))
        names = [c.split(" ")[0] for c in _PARTIAL.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), _KINDS, strict=True)], names=names)

    for batch in batches:
        for piece in tx.pieces(batch, "text"):
            ids, w = _read(piece, known, place)
            ctx = contexts(ids, w, np.arange(len(ids)))
            n, doc, rare = np.diff(w.first), w.doc(), ids >= KNOWN
            total = np.bincount(doc, weights=log_probs(p, ctx, ids) - np.where(rare, log[ids], 0), minlength=len(n)) if len(ids) else np.zeros(len(n))
            held.append((piece.column("doc_id").to_pylist(), n, total, doc[rare], w.hash[rare]))
            size += int(rare.sum()) + len(n)
            if size > _CHUNK:
                yield rows()
                held, size, chunks = [], 0, chunks + 1
    if held:
        yield rows()


def _weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For the words of each chunk, the logarithms of their counts in the corpus; a task has all chunks of its buckets."""
    held: dict[int, list[tuple]] = {}
    for batch in batches:
        for r in batch.to_pylist():
            held.setdefault(r["bucket"], []).append((r["chunk"], np.frombuffer(r["words"], np.uint64), np.frombuffer(r["counts"], np.int64)))
    for bucket in sorted(held):
        chunk, words, counts = zip(*held.pop(bucket), strict=True)
        _, at = np.unique(np.concatenate(words), return_inverse=True)
        log = np.log(np.bincount(at, weights=np.concatenate(counts)))[at]
        parts = np.split(log, np.cumsum([len(x) for x in words])[:-1])
        yield pa.RecordBatch.from_arrays([pa.array(chunk), pa.array([bucket] * len(chunk), pa.int32()), tx.binary(parts)], names=["chunk", "bucket", "logs"])


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.to_pylist():
            n, total = np.array(r["n"], np.int64), np.array(r["total"], float)
            if r["code"]:
                log = np.concatenate([np.frombuffer(x["logs"], np.float64) for x in sorted(r["parts"], key=lambda x: x["bucket"])])
                total += np.bincount(np.frombuffer(r["doc"], np.int32), weights=log[np.frombuffer(r["code"], np.int32)], minlength=len(n))
            out = pa.RecordBatch.from_arrays([pa.array(r["doc_id"], pa.int64()), pa.array(n), pa.array(total), pa.array(total / np.maximum(n, 1), mask=n == 0)], names=["doc_id", "n_words", "log_prob", "mean_log_prob"])
            for a in range(0, out.num_rows, 1 << 16):
                yield out.slice(a, 1 << 16)


def vocabulary(docs: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sorted hashes of the most frequent words of the corpus, their numbers by rank, how often each number
    occurs); ties by hash. A number that words share has the sum of their counts."""
    counts = written(docs.select(F.col("text").cast("string").alias("text")).mapInArrow(lean(_counted), "h long, n long").groupBy("h").agg(F.sum("n").alias("n")))
    rows = counts.orderBy(F.desc("n"), "h").limit(KNOWN).collect()
    top, n = np.array([r["h"] for r in rows], np.int64).view(np.uint64), np.array([r["n"] for r in rows], float)
    often = np.zeros(V)
    for r in counts.groupBy(F.col("h").bitwiseAND(V - KNOWN - 1).alias("k")).agg(F.sum("n").alias("n")).collect():
        often[KNOWN + r["k"]] = r["n"]
    np.subtract.at(often, KNOWN + (top % np.uint64(V - KNOWN)).astype(np.int64), n)
    often[: len(n)] = n
    order = np.argsort(top)
    return top[order], order.astype(np.int64), often


def train(docs: DataFrame, known: np.ndarray, place: np.ndarray, often: np.ndarray, rounds: int = 2, every: int = 2, rate: float = 0.15, seed: int = 11) -> np.ndarray:
    """Parameters after `rounds` passes over the corpus, each masking another `every`-th part of all words;
    there are as many passes as parts, or more, so that every word is masked."""
    if rounds < every:
        raise ValueError(f"{rounds} passes leave words out that are masked in {every} parts")
    spark = docs.sparkSession
    texts = docs.select(F.col("text").cast("string").alias("text"))
    x = flat(initial(seed, often))
    parts = -(-len(x) // _SLICE)
    for turn in range(rounds):
        sent = spark.sparkContext.broadcast((x, known, place))
        local = texts.mapInArrow(lean(partial(_trained, sent, every, turn % every, rate)), "part int, x binary, n double")
        mean = local.repartition(min(parts, partitions(spark)), "part").mapInArrow(lean(_averaged), "part int, x binary")
        got = {r["part"]: np.frombuffer(r["x"], np.float32) for r in mean.collect()}
        if got:
            x = np.concatenate([got[k] for k in range(parts)])
    return x


def scores(docs: DataFrame, rounds: int = 2, every: int = 2, seed: int = 11) -> DataFrame:
    """(doc_id, n_words, log_prob, mean_log_prob) for every row of docs.

    log_prob sums, over all words of the text, the log-probability of the word given up to two words on either
    side; mean_log_prob divides it by the number of words. All words are counted, and the network trained, on
    all texts of docs; what comes to the driver is the network, of fixed size. The counts stay in the executors.

    Null, empty and wordless texts: 0 words, log_prob 0, mean_log_prob null. Rows of null doc_id are scored like
    others, repeated rows each get the same score. Very long texts are scored whole. No documents: no rows. Ties in word counts go by hash. Other
    columns are ignored, whatever their names.
    """
    known, place, often = vocabulary(docs)
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast((train(docs, known, place, often, rounds, every, seed=seed), known, place, often))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    parts = partitions(spark)
    partial_ = written(rows.mapInArrow(lean(partial(_scored, sent, parts)), _PARTIAL))
    words = partial_.where("bucket is not null").select("chunk", "bucket", "words", "counts").repartitionById(parts, F.col("bucket"))
    logs = words.mapInArrow(lean(_weighed), "chunk string, bucket int, logs binary").groupBy("chunk").agg(F.collect_list(F.struct("bucket", "logs")).alias("parts"))
    chunks = partial_.where("bucket is null").select("chunk", "doc_id", "n", "total", "doc", "code").join(logs, "chunk", "left")
    return chunks.mapInArrow(lean(_summed), "doc_id long, n_words long, log_prob double, mean_log_prob double")
