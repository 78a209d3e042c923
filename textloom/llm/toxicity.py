"""Toxic spans by a linear-chain conditional random field over words.

Labels of documents become labels of words, as no labels of words exist: a word of a toxic document is a toxic token
if it occurs in a significantly larger share of the toxic than of the clean labelled documents of its language. The
field has two states, clean and toxic; forward-backward gives each word's probability of the toxic state. Labels are
then amended by the field itself and the field fitted once more.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm import _text as tx
from textloom.llm._lean import release

BITS = 20
PREFIXES = (5, 7)  # bytes of a word's beginnings that are features
_SALT = tuple(np.uint64(x) for x in (0, 0x51ED2701A5C3, 0x7F4A7C159E37, 0x2545F4914F6C, 0x6C8E9CF57093))
FLOOR = 0.1  # marginals below it are what any word has, and would add up over a long text
_CHUNK = 1 << 18  # words that the fit passes at once
RESULT = "struct<n_words:long,score:double,toxic:boolean,spans:array<struct<start:int,end:int>>>"


@dataclass
class Field:
    """Log-linear parameters: weights of hashed features for the toxic state, transitions, start, threshold."""

    weight: np.ndarray
    trans: np.ndarray
    start: np.ndarray
    threshold: float


def features(w: tx.Words) -> np.ndarray:
    """Five feature numbers of every word: itself, the word before it and the one after it in its text, and its
    beginnings, by which inflected forms that the labels don't have are known; words as short as a beginning share
    one number for it."""
    h = w.hash
    before, after = np.zeros_like(h), np.zeros_like(h)
    before[1:], after[:-1] = h[:-1], h[1:]
    first, last = w.first[:-1][np.diff(w.first) > 0], w.first[1:][np.diff(w.first) > 0] - 1
    before[first], after[last] = 0, 0
    shift = np.uint64(64 - BITS)
    parts = (h, before, after, *(tx.beginnings(w, n) for n in PREFIXES))
    return np.stack([(tx.mix(x ^ s) >> shift).astype(np.int32) for x, s in zip(parts, _SALT, strict=True)])


def emissions(field: Field, feats: np.ndarray) -> np.ndarray:
    return np.clip(field.weight[feats].sum(axis=0, dtype=np.float64), -30, 30)


def forward_backward(score: np.ndarray, begins: np.ndarray, trans: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(probability of the toxic state of each word, expected 2x2 transitions inside texts).

    score is the toxic state's emission, the clean state's is 0; begins marks the first words of texts. The words
    are cut into equal chunks; the chunks' transfer matrices give each chunk's entry and exit, and then all
    chunks are passed at once.
    """
    n = len(score)
    if not n:
        return np.zeros(0), np.zeros((2, 2))
    size = max(1, int(np.sqrt(n)))
    chunks = -(-n // size)
    pad = chunks * size - n
    e = np.exp(np.append(score, np.zeros(pad))).reshape(chunks, size).T
    reset = np.append(begins, np.ones(pad, bool)).reshape(chunks, size).T
    t, s = np.exp(trans), np.exp(start)
    m = np.empty((2, 2, size, chunks))
    for i in range(2):
        for j in range(2):
            m[i, j] = np.where(reset, s[j], t[i, j])
    m[:, 1] *= e
    p = [[np.ones(chunks), np.zeros(chunks)], [np.zeros(chunks), np.ones(chunks)]]
    for k in range(size):
        (a, b), (c, d) = p
        a, b = a * m[0, 0, k] + b * m[1, 0, k], a * m[0, 1, k] + b * m[1, 1, k]
        c, d = c * m[0, 0, k] + d * m[1, 0, k], c * m[0, 1, k] + d * m[1, 1, k]
        z = a + b + c + d
        p = [[a / z, b / z], [c / z, d / z]]
    transfer = np.array(p).transpose(2, 0, 1)
    into, out = np.empty((chunks, 2)), np.empty((chunks, 2))
    v, u = np.array([0.5, 0.5]), np.array([0.5, 0.5])
    for c in range(chunks):
        into[c] = v
        v = v @ transfer[c]
        v = v / v.sum()
    for c in range(chunks - 1, -1, -1):
        out[c] = u
        u = transfer[c] @ u
        u = u / u.sum()
    fwd, bwd = np.empty((2, size, chunks)), np.empty((2, size, chunks))
    x, y = into.T
    for k in range(size):
        x, y = x * m[0, 0, k] + y * m[1, 0, k], x * m[0, 1, k] + y * m[1, 1, k]
        z = x + y
        x, y = x / z, y / z
        fwd[0, k], fwd[1, k] = x, y
    x, y = out.T
    for k in range(size - 1, -1, -1):
        bwd[0, k], bwd[1, k] = x, y
        x, y = m[0, 0, k] * x + m[0, 1, k] * y, m[1, 0, k] * x + m[1, 1, k] * y
        z = x + y
        x, y = x / z, y / z
    both = fwd * bwd
    gamma = (both[1] / both.sum(axis=0)).T.ravel()[:n]
    f = fwd.transpose(0, 2, 1).reshape(2, -1)[:, : n - 1]
    g = (bwd * np.stack([np.ones_like(e), e])).transpose(0, 2, 1).reshape(2, -1)[:, 1:n]
    inside = ~begins[1:]
    xi = f[:, None, inside] * t[:, :, None] * g[None][:, :, inside]
    return gamma, (xi / xi.sum(axis=(0, 1))).sum(axis=2)


def _odds(a: np.ndarray, b: np.ndarray, n1: int, n0: int) -> np.ndarray:
    """P-values of the likelihood ratio test that words in a of n1 and b of n0 texts are in equal shares of both."""
    p = (a + b) / max(1, n1 + n0)

    def part(x: np.ndarray, q: np.ndarray) -> np.ndarray:
        return np.where(x > 0, x * np.log(np.maximum(x, 1) / np.maximum(q, 1e-300)), 0.0)

    g = 2 * (part(a, n1 * p) + part(n1 - a, n1 * (1 - p)) + part(b, n0 * p) + part(n0 - b, n0 * (1 - p)))
    return np.array([math.erfc(math.sqrt(x)) for x in np.maximum(g, 0) / 2])


def _testable(count: np.ndarray, n1: int, n0: int, false: float) -> int:
    """The least k such that at most k words can reach a p-value of false / k, by how many texts have them."""
    c, often = np.unique(count, return_counts=True)
    best = np.sort(np.repeat(_odds(np.minimum(c, n1), np.maximum(c - n1, 0), n1, n0), often))
    k = np.arange(1, len(best) + 1)
    return int(np.argmax(np.searchsorted(best, false / k, side="right") <= k)) + 1


def token_labels(w: tx.Words, toxic: np.ndarray, group: np.ndarray | None = None, ratio: float = 5.0, false: float = 0.01) -> np.ndarray:
    """Labels of words from labels of texts: in a toxic text, the words whose share of the group's toxic texts is
    `ratio` times their share of its clean ones or more, at a false discovery rate of `false` within the group
    (Benjamini and Hochberg; words too rare to be told from chance don't count as tests, after Tarone and Gilbert). Groups are languages, so that a rare one isn't measured by the words of all."""
    group = np.zeros(len(toxic), np.int64) if group is None else group
    doc = w.doc()
    out = np.zeros(len(doc), bool)
    for k in np.unique(group):
        n1, n0 = int((toxic & (group == k)).sum()), int((~toxic & (group == k)).sum())
        at = np.flatnonzero(group[doc] == k)
        if not (n1 and n0 and len(at)):
            continue
        _, which = np.unique(w.hash[at], return_inverse=True)
        pair = np.unique(which * len(toxic) + doc[at])
        word, hot = pair // len(toxic), toxic[pair % len(toxic)]
        size = int(which.max()) + 1
        a, b = np.bincount(word[hot], minlength=size).astype(float), np.bincount(word[~hot], minlength=size).astype(float)
        some = np.flatnonzero((a + 0.5) / (n1 + 1) >= ratio * (b + 0.5) / (n0 + 1))
        p = _odds(a[some], b[some], n1, n0)
        order = np.argsort(p, kind="stable")
        below = np.flatnonzero(p[order] <= false * np.arange(1, len(p) + 1) / _testable(a + b, n1, n0, false))
        bad = np.zeros(size, bool)
        bad[some[order[: below[-1] + 1 if len(below) else 0]]] = True
        out[at] = bad[which] & toxic[doc[at]]
    return out


def distinct_texts(texts: list[str | None], toxic: list[bool], size: int = 5, hands: int = 8, same: int = 3) -> list[int]:
    """Positions of the texts without near copies of those before them of the same label: copies would make each of
    their words look like a mark of the label. Near is to have `same` of `hands` least hashes of n-grams in common."""
    w = tx.scan(pa.array(texts, pa.large_string()))
    known: dict[tuple, list[int]] = {}
    out = []
    for i, (a, b) in enumerate(zip(w.first.tolist(), w.first[1:].tolist(), strict=False)):
        g = tx.grams(w.hash[a:b], min(size, b - a)) if b > a else np.zeros(1, np.uint64)
        least = [(bool(toxic[i]), k, int(tx.mix(g ^ np.uint64(0x9E3779B97F4A7C15 * (k + 1) % 2**64)).min())) for k in range(hands)]
        met: dict[int, int] = {}
        for key in least:
            for j in known.get(key, ()):
                met[j] = met.get(j, 0) + 1
        if max(met.values(), default=0) < same:
            out.append(i)
            for key in least:
                known.setdefault(key, []).append(i)
    return out


def _chunked(w: tx.Words) -> list[slice]:
    """Whole texts, of about _CHUNK words together."""
    cut = np.unique(w.first[np.append(0, np.searchsorted(w.first, np.arange(_CHUNK, w.first[-1] + _CHUNK, _CHUNK)).clip(max=len(w.first) - 1))])
    return [slice(a, b) for a, b in zip(cut.tolist(), cut[1:].tolist(), strict=False)]


def _marginals(field: Field, feats: np.ndarray, begins: np.ndarray, chunks: list[slice]) -> np.ndarray:
    return np.concatenate([forward_backward(emissions(field, feats[:, z]), begins[z], field.trans, field.start)[0] for z in chunks])


def _maximised(w: tx.Words, feats: np.ndarray, label: np.ndarray, texts: int, steps: int, rate: float, l2: float, least: int, before: Field | None = None) -> Field:
    used, at, often = np.unique(feats, return_inverse=True, return_counts=True)
    at = at.reshape(feats.shape).astype(np.int32)
    begins, chunks = _begins(w), _chunked(w)
    y, inside = label.astype(int), ~begins[1:]
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[:-1][inside], y[1:][inside]), 1)
    first = np.bincount(y[begins], minlength=2)
    x = np.zeros(len(used) + 6)
    x[-6:] = np.log([0.9995, 0.0005, 0.9, 0.1, 0.9995, 0.0005])
    if before:
        x[:-6], x[-6:-2], x[-2:] = before.weight[used], before.trans.ravel(), before.start
    mean, square = np.zeros_like(x), np.zeros_like(x)
    for step in range(1, steps + 1):
        grad = np.concatenate([np.zeros(len(used)), seen.ravel(), first]) - l2 * texts * x
        for z in chunks:
            gamma, pairs = forward_backward(np.clip(x[:-6][at[:, z]].sum(axis=0), -30, 30), begins[z], x[-6:-2].reshape(2, 2), x[-2:])
            miss = label[z] - gamma
            for a in at[:, z]:
                grad[:-6] += np.bincount(a, weights=miss, minlength=len(used))
            hot = gamma[begins[z]].sum()
            grad[-6:] -= np.array([*pairs.ravel(), begins[z].sum() - hot, hot])
        grad[:-6][often < least] = 0
        mean, square = 0.9 * mean + 0.1 * grad, 0.99 * square + 0.01 * grad**2
        x += rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
    weight = np.zeros(1 << BITS, np.float32)
    weight[used] = x[:-6]
    return Field(weight, x[-6:-2].reshape(2, 2).copy(), x[-2:].copy(), 0.5)


def _total(gamma: np.ndarray, doc: np.ndarray, texts: int) -> np.ndarray:
    return np.bincount(doc, weights=np.where(gamma >= FLOOR, gamma, 0), minlength=texts) if len(gamma) else np.zeros(texts)


def _begins(w: tx.Words) -> np.ndarray:
    begins = np.zeros(len(w.hash), bool)
    begins[w.first[:-1][np.diff(w.first) > 0]] = True
    return begins


def fit(texts: list[str | None], toxic: list[bool], group: list[str] | None = None, steps: int = 30, rate: float = 0.3, l2: float = 1e-4, least: int = 3) -> Field:
    """Maximum conditional likelihood by full-batch Adam, with the features that occur `least` times or more (one that
    occurs less is learned by heart); without both kinds of texts, a field that finds nothing.

    Fitted twice: words of toxic texts that the first field tags, such as rare forms known by their beginning, are
    labelled too, and the second field goes on from the first one with these labels."""
    own = distinct_texts(texts, toxic)
    kind, group = np.array(toxic, bool)[own], group and [group[i] for i in own]
    w = tx.scan(pa.array([texts[i] for i in own], pa.large_string()))
    groups = np.unique([g or "" for g in group], return_inverse=True)[1] if group else None
    label = token_labels(w, kind, groups) if kind.any() and not kind.all() and len(w.hash) else np.zeros(len(w.hash), bool)
    if not label.any():
        return Field(np.zeros(1 << BITS, np.float32), np.log([[0.5, 0.5], [0.5, 0.5]]), np.log([1 - 1e-9, 1e-9]), float("inf"))
    feats, begins, chunks, doc = features(w), _begins(w), _chunked(w), w.doc()
    field = _maximised(w, feats, label, len(kind), steps, rate, l2, least)
    label |= (_marginals(field, feats, begins, chunks) >= 0.5) & kind[doc]
    field = _maximised(w, feats, label, len(kind), steps, rate, l2, least, field)
    field.threshold = _threshold(_total(_marginals(field, feats, begins, chunks), doc, len(kind)), kind)
    return field


def _threshold(score: np.ndarray, toxic: np.ndarray) -> float:
    """The score that separates the labels with the best balanced accuracy; between two texts, their geometric
    mean; never below half a toxic word."""
    order = np.argsort(score, kind="stable")
    s, t = np.maximum(score[order], 1e-9), toxic[order]
    caught = 1 - np.concatenate([[0], np.cumsum(t)]) / max(1, t.sum())
    spared = np.concatenate([[0], np.cumsum(~t)]) / max(1, (~t).sum())
    k = int(np.argmax(caught + spared))
    low, high = s[k - 1] if k else 1e-9, s[k] if k < len(s) else 1e9
    return max(0.5, float(np.sqrt(low * high)))


def tag(field: Field, texts: pa.Array) -> list[dict]:
    """What the field says of each text."""
    w = tx.scan(texts)
    begins, n = _begins(w), np.diff(w.first)
    gamma, _ = forward_backward(emissions(field, features(w)), begins, field.trans, field.start) if len(w.hash) else (np.zeros(0), None)
    total = _total(gamma, w.doc(), len(n))
    spans: dict[int, list[dict]] = {}
    hit = gamma >= 0.5
    if hit.any():
        begin, end = w.chars()
        doc = w.doc()
        for a, z in zip(*(x.tolist() for x in tx.runs(hit)), strict=True):
            cuts = [a, *(np.flatnonzero(begins[a + 1 : z]) + a + 1).tolist(), z]
            for i, j in zip(cuts, cuts[1:], strict=False):
                spans.setdefault(int(doc[i]), []).append({"start": int(begin[i]), "end": int(end[j - 1])})
    return [{"n_words": int(n[i]), "score": float(total[i]), "toxic": bool(total[i] >= field.threshold), "spans": spans.get(i, [])} for i in range(len(n))]


def trained(docs: DataFrame, labels: DataFrame, fit_rows: int = 1000) -> Field:
    """Fits the field on at most `fit_rows` labelled documents of either kind, evenly of each language (where docs
    has a column lang), chosen by hash of doc_id; of equal texts, one."""
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("")) if "lang" in docs.columns else F.lit("")
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("toxic").cast("int") != 0).alias("toxic")).dropna().distinct()
    light = docs.select(F.col("doc_id").cast("long").alias("doc_id"), lang.alias("lang"), F.xxhash64(F.col("text").cast("string")).alias("h")).where("doc_id is not null")
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    each = known.join(light, "doc_id").groupBy("toxic", "lang", "h").agg(F.min("doc_id").alias("doc_id"))
    for part in ([F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(64))], []):  # no task ranks all rows of a language
        ranked = F.row_number().over(Window.partitionBy("toxic", "lang", *part).orderBy(*order))
        each = each.withColumn("turn", ranked).where(F.col("turn") <= fit_rows)
    some = each.where("toxic").orderBy("turn", *order).limit(fit_rows).union(each.where("not toxic").orderBy("turn", *order).limit(fit_rows))
    some = some.select("doc_id", "toxic", "lang").toPandas()
    if some.empty:
        return fit([], [])
    schema = "doc_id long, toxic boolean, lang string"
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), lang.alias("lang"), F.col("text").cast("string").alias("text"))
    rows = texts.join(F.broadcast(docs.sparkSession.createDataFrame(some, schema)), ["doc_id", "lang"]).orderBy("doc_id", "text", "toxic").collect()
    return fit([r["text"] for r in rows], [r["toxic"] for r in rows], [r["lang"] for r in rows])


def tagger(docs: DataFrame, field: Field) -> Column:
    """A column that tags docs.text."""
    sent = docs.sparkSession.sparkContext.broadcast(field)
    kind = pa.struct([("n_words", pa.int64()), ("score", pa.float64()), ("toxic", pa.bool_()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))])

    @F.arrow_udf(RESULT)
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            batch = pa.RecordBatch.from_arrays([texts], names=["text"])
            out = [x for piece in tx.pieces(batch, "text") for x in tag(sent.value, piece.column("text"))]
            yield pa.array(out, kind)
        release()

    return of(F.col("text").cast("string"))


def toxic_spans(docs: DataFrame, labels: DataFrame, fit_rows: int = 1000) -> DataFrame:
    """(doc_id, n_words, score, toxic, spans) for every row of docs.

    score is the expected number of toxic words, the sum of the marginals of FLOOR or more; toxic, whether it reaches
    the threshold learned from the labelled documents; spans, the character offsets [start, end) of the runs of words
    with a marginal of one half or more. Only `fit_rows` labelled documents of either kind come to the driver.

    Null and empty texts have no words, score 0 and no span. Rows of null doc_id are tagged like others; repeated
    rows each get the same result. Very long texts are tagged whole. Labels that are null, or of unknown documents, are not used; without both
    kinds of labels nothing is toxic. No documents: no rows. Ties: a score equal to the threshold is toxic. Other
    columns are ignored, whatever their names.
    """
    found = tagger(docs, trained(docs, labels, fit_rows))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), found.alias("found")).select("doc_id", "found.*")


def without_toxic(docs: DataFrame, labels: DataFrame, fit_rows: int = 1000) -> DataFrame:
    """The rows of docs that aren't toxic, as toxic_spans() has it, with all columns, whatever their names. Rows of null or
    empty text, and of null doc_id, stay unless they are tagged; repeated rows stay or go together; no documents: no rows."""
    return docs.where(~tagger(docs, trained(docs, labels, fit_rows))["toxic"])
