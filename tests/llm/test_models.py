"""Language-model scoring, toxicity and search against brute force and on held-out texts."""

import itertools
import random
import time
from collections import defaultdict

import numpy as np
import pytest

from textloom.llm import _text as tx
from textloom.llm import lm_scoring as L
from textloom.llm import topk
from textloom.llm import toxicity as T


def test_words():
    texts = ["Hello, World-2 ÄöÜ x", "", None, "a", "日本 語", "!" * 50]
    import pyarrow as pa

    w = tx.scan(pa.array(texts))
    begin, end = w.chars()
    for i, t in enumerate(texts):
        got = [t[a:z] for a, z in zip(begin[w.first[i] : w.first[i + 1]], end[w.first[i] : w.first[i + 1]], strict=True)] if t else []
        assert [x.lower() if x.isascii() else x for x in got] == [x if x.isascii() else y for x, y in zip(tx.plain_words(t), got, strict=True)]


def test_lm_probabilities_sum_to_one():
    p = L.initial(3, np.ones(L.V))
    ctx = np.array([[5], [L.PAD], [7], [9]])
    total = np.exp(L.log_probs(p, np.repeat(ctx, L.V, axis=1), np.arange(L.V))).sum()
    assert abs(total - 1) < 1e-3


def test_lm_gradient():
    p = L.initial(4, np.arange(L.V))
    rng = np.random.default_rng(0)
    ctx, target = rng.integers(0, L.V, (4, 50)), rng.integers(0, L.V, 50)
    before = L.log_probs(p, ctx, target).mean()
    net = L.Adagrad(p, 0.01)
    for _ in range(5):
        net.step(ctx, target)
    assert L.log_probs(net.p, ctx, target).mean() > before + 0.01
    grads = {}
    net.dense = lambda k, g, at=slice(None): grads.setdefault(k, []).append((g.copy(), at))
    net.step(ctx, target)
    eps = 1e-2
    for k, at in (("c", (3, 5)), ("b", (2,)), ("cb", (9,))):
        q = {n: v.copy() for n, v in net.p.items()}
        q[k][at] += eps
        up = L.log_probs(q, ctx, target).astype(np.float64).mean()
        q[k][at] -= 2 * eps
        slope = (up - L.log_probs(q, ctx, target).astype(np.float64).mean()) / (2 * eps)
        assert abs(slope + grads[k][0][0][at]) < 2e-3


def test_lm_numbers():
    """Known words are found whatever bits they share, beyond the last one too; the others get hashed numbers."""
    rng = np.random.default_rng(0)
    crowd = np.uint64(7 << 60) + np.arange(5, dtype=np.uint64)
    for known in ([], [3], [0, 2**64 - 1, 2**64 - 2], [*crowd.tolist(), 2**63], rng.integers(0, 2**64, L.KNOWN, dtype=np.uint64).tolist()):
        known = np.unique(np.array(known, np.uint64))
        place = rng.permutation(len(known))
        hashes = np.concatenate([known, rng.integers(0, 2**64, 500, dtype=np.uint64), crowd, known])
        numbers = dict(zip(known.tolist(), place.tolist(), strict=True))
        assert L.numbers(hashes, known, place).tolist() == [numbers.get(h, L.KNOWN + h % (L.V - L.KNOWN)) for h in hashes.tolist()]


def test_lm_work():
    """Scores are those of the network written out word by word, in less time than by logits of a row for each word."""
    rng = np.random.default_rng(5)
    share = 1 / np.arange(1, L.V + 1)
    p, n = L.initial(1, share * 1e6), 1 << 14
    ctx, target = rng.choice(L.V, (2 * L.SIDE, n), p=share / share.sum()), rng.choice(L.V, n, p=share / share.sum())

    def lse(x, at):
        hit, top = x[np.arange(len(x)), at].copy(), x.max(axis=1)
        x -= top[:, None]
        np.exp(x, out=x)
        return hit - top - np.log(x @ np.ones(x.shape[1], np.float32))

    def rows():
        order = np.argsort(target % L.CLASSES, kind="stable")
        cls, member = target[order] % L.CLASSES, target[order] // L.CLASSES
        h = np.tanh(sum(p["e"][k][ctx[k, order]] for k in range(2 * L.SIDE)) + p["b"])
        lp, out = lse(h @ p["c"] + p["cb"], cls), np.empty(n, np.float32)
        cut = np.searchsorted(cls, np.arange(L.CLASSES + 1))
        for c in range(L.CLASSES):
            z = slice(cut[c], cut[c + 1])
            lp[z] += lse(h[z] @ p["m"][c] + p["mb"][c], member[z])
        out[order] = lp
        return out

    def least(f):
        times = []
        for _ in range(15):
            began = time.perf_counter()
            out = f()
            times.append(time.perf_counter() - began)
        return min(times), out

    (new, got), (old, expected) = least(lambda: L.log_probs(p, ctx, target)), least(rows)
    np.testing.assert_allclose(got, expected, rtol=1e-4, atol=1e-4)
    assert new < 0.95 * old


def test_lm_step():
    """A step is that of the network written out class by class and dimension by dimension, in less time."""
    rng = np.random.default_rng(6)
    share = 1 / (50 + np.arange(L.V))
    n, often = 1 << 13, share * 1e6
    ctx, target = rng.choice(L.V, (2 * L.SIDE, n), p=share / share.sum()), rng.choice(L.V - 64, n, p=share[:-64] / share[:-64].sum())
    ctx[0, :100] = L.PAD
    target[target % L.CLASSES == 7] = 8  # a class without words

    class Plain(L.Adagrad):
        def dense(self, k, grad, at=slice(None)):
            self.s[k][at] += grad * grad
            self.p[k][at] -= self.rate * grad / np.sqrt(self.s[k][at])

        def softmax(self, x, at):
            x -= x.max(axis=0)
            hit = x[at, np.arange(len(at))]
            np.exp(x, out=x)
            z = np.ones(len(x), np.float32) @ x
            x *= 1 / z
            x[at, np.arange(len(at))] -= 1
            x /= self.n
            return (hit - np.log(z)).sum(dtype=float), x

        def step(self, ctx, target):
            self.n = len(target)
            p, order = self.p, np.argsort((target % L.CLASSES).astype(np.int16), kind="stable")
            ctx, cls, member = ctx[:, order], target[order] % L.CLASSES, target[order] // L.CLASSES
            h = np.tanh(sum(p["e"][k].take(ctx[k], axis=0) for k in range(2 * L.SIDE)) + p["b"])
            total, q = self.softmax(p["c"].T @ h.T + p["cb"][:, None], cls)
            dh = q.T @ p["c"].T
            self.dense("c", h.T @ q.T)
            self.dense("cb", q.sum(axis=1))
            cut = np.searchsorted(cls, np.arange(L.CLASSES + 1))
            for c in np.flatnonzero(np.diff(cut)):
                z = slice(cut[c], cut[c + 1])
                more, q = self.softmax(p["m"][c].T @ h[z].T + p["mb"][c][:, None], member[z])
                total += more
                dh[z] += q.T @ p["m"][c].T
                self.dense("m", h[z].T @ q.T, c)
                self.dense("mb", q.sum(axis=1), c)
            dh *= 1 - h * h
            self.dense("b", dh.sum(axis=0))
            columns, grad = np.ascontiguousarray(dh.T, np.float64), np.empty((L.DIM, L.V + 1))
            for k in range(2 * L.SIDE):
                for d in range(L.DIM):
                    grad[d] = np.bincount(ctx[k], weights=columns[d], minlength=L.V + 1)
                self.dense("e", grad.T.astype(np.float32, order="C"), k)
            return total / self.n

    nets, least = [L.Adagrad(L.initial(1, often), 0.15), Plain(L.initial(1, often), 0.15)], [9.0, 9.0]
    for size in (n, 1, 3, *[n] * 20):  # in turns, so that both have the same machine
        got = []
        for i, net in enumerate(nets):
            began = time.perf_counter()
            got.append(net.step(ctx[:, :size], target[:size]))
            if size == n:
                least[i] = min(least[i], time.perf_counter() - began)
        np.testing.assert_allclose(*got, rtol=1e-5)
    for k in nets[0].p:
        np.testing.assert_allclose(nets[0].p[k], nets[1].p[k], atol=2e-5, err_msg=k)
        np.testing.assert_allclose(nets[0].s[k], nets[1].s[k], rtol=1e-3, err_msg=k)
    assert least[0] < 0.8 * least[1]


def test_lm_scores(spark, docs, corpus, nothing):
    got = L.scores(docs).collect()
    assert len(got) == len(corpus)
    for r in got:
        assert (r["mean_log_prob"] is None) == (r["n_words"] == 0) and (r["n_words"] or r["log_prob"] == 0)
    assert sorted(r["n_words"] for r in got) == sorted(len(tx.plain_words(r[1])) for r in corpus)
    assert L.scores(nothing).collect() == []


def test_lm_prefers_sense(spark):
    rng = random.Random(1)
    chain = {f"a{i}": [f"a{(i * 7 + k) % 40}" for k in (1, 2)] for i in range(40)}

    def text(n):
        w = ["a0"]
        for _ in range(n):
            w.append(rng.choice(chain[w[-1]]))
        return w

    good = [text(200) for _ in range(150)]
    rows = [(i, " ".join(t)) for i, t in enumerate(good)] + [(1000 + i, " ".join(rng.sample(t, len(t)))) for i, t in enumerate(good[:10])]
    got = {r["doc_id"]: r["mean_log_prob"] for r in L.scores(spark.createDataFrame(rows, "doc_id long, text string"), rounds=3, every=3).collect()}
    assert all(got[i] > got[1000 + i] for i in range(10))


def test_lm_trains_on_every_word(spark, monkeypatch):
    """With the production defaults, each word is masked."""
    seen = []
    whole = L.partial

    def noted(f, *args):
        if f is L._trained:
            seen.append(args[1:3])
        return whole(f, *args)

    monkeypatch.setattr(L, "partial", noted)
    text = [f"w{i % 97}" for i in range(5000)]
    df = spark.createDataFrame([(i, " ".join(text[i * 50 : i * 50 + 50])) for i in range(100)], "doc_id long, text string")
    known, place, often = L.vocabulary(df)[:3]
    L.train(df, known, place, often)
    assert len(seen) > 1 and {e for e, _ in seen} == {seen[0][0]}
    assert {t for _, t in seen} == set(range(seen[0][0]))
    with pytest.raises(ValueError, match="leave words out"):
        L.train(df, known, place, often, rounds=2, every=3)


def test_lm_words_add_up(spark, monkeypatch):
    """Words that share a number differ by their counts, and all words of the corpus add up to 1, over many chunks."""
    monkeypatch.setattr(L, "_CHUNK", 300)
    words = [f"u{i}" for i in range(6000)]
    times = {w: 1 + i % 4 if i >= 2500 else 9 for i, w in enumerate(words)}
    rows = [(i, w) for i, w in enumerate(words)] + [(10000, " ".join(w for w in words for _ in range(times[w] - 1)))]
    got = {r["doc_id"]: r["log_prob"] for r in L.scores(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert len(got) == len(rows) and abs(sum(np.exp(got[i]) for i in range(len(words))) - 1) < 1e-2
    import pyarrow as pa

    shared = {}
    for i, h in enumerate(tx.scan(pa.array(words)).hash.tolist()):
        if times[words[i]] < 9:
            shared.setdefault(h % (L.V - L.KNOWN), []).append(i)
    pairs = [(a, b) for g in shared.values() for a, b in zip(g, g[1:], strict=False) if times[words[a]] != times[words[b]]]
    assert len(pairs) > 100
    for a, b in pairs:
        assert got[a] - got[b] == pytest.approx(np.log(times[words[a]] / times[words[b]]), abs=1e-4)


def test_lm_defaults_prefer_sense(spark):
    rng = random.Random(4)
    text = lambda: [f"a{(k * 7) % 40}" for k in range(rng.randrange(40), 240)]
    good = [text() for _ in range(150)]
    rows = [(i, " ".join(t)) for i, t in enumerate(good)] + [(1000 + i, " ".join(rng.sample(t, len(t)))) for i, t in enumerate(good[:10])]
    got = {r["doc_id"]: r["mean_log_prob"] for r in L.scores(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i] > got[1000 + i] + 0.5 for i in range(10))


def test_forward_backward():
    rng = np.random.default_rng(0)
    for n in (1, 2, 5, 9):
        score, begins = rng.normal(size=n), rng.random(n) < 0.3
        begins[0] = True
        trans, start = rng.normal(size=(2, 2)), rng.normal(size=2)
        gamma, pairs = T.forward_backward(score, begins, trans, start)
        total, hot, expect = 0.0, np.zeros(n), np.zeros((2, 2))
        for y in itertools.product((0, 1), repeat=n):
            w = np.exp(sum(score[i] * y[i] + (start[y[i]] if begins[i] else trans[y[i - 1], y[i]]) for i in range(n)))
            total += w
            hot += w * np.array(y)
            for i in range(1, n):
                if not begins[i]:
                    expect[y[i - 1], y[i]] += w
        assert np.allclose(gamma, hot / total) and np.allclose(pairs, expect / total)


def toxic_rows(n=400):
    rng = random.Random(8)
    bad = ["trash", "idiot", "moron", "scum"]
    rows, labels, truth = [], [], {}
    for i in range(n):
        w = [f"w{rng.randrange(800)}" for _ in range(rng.randrange(30, 200))]
        truth[i] = i % 4 == 0
        if truth[i]:
            for _ in range(rng.randrange(2, 6)):
                w[rng.randrange(len(w))] = rng.choice(bad)
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(truth[i])))
    return rows, labels, truth


def test_toxicity_held_out(spark):
    rows, labels, truth = toxic_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    known = spark.createDataFrame(labels[:200], "doc_id long, quality int, toxic int")
    got = T.toxic_spans(docs, known).collect()
    held = [r for r in got if r["doc_id"] >= 200]
    assert sum(r["toxic"] == truth[r["doc_id"]] for r in held) >= 0.97 * len(held)
    text = dict(rows)
    found = [text[r["doc_id"]][s["start"] : s["end"]] for r in held if truth[r["doc_id"]] for s in r["spans"]]
    assert sum(all(x in ("trash", "idiot", "moron", "scum") for x in f.split()) for f in found) >= 0.95 * len(found) > 0
    kept = {r["doc_id"] for r in T.without_toxic(docs, known).collect()}
    assert kept == {r["doc_id"] for r in got if not r["toxic"]}


def test_toxicity_odd_input(spark, docs, corpus, nothing):
    rows, labels, _ = toxic_rows()
    known = spark.createDataFrame([*labels, (None, 1, 1), (100, None, None), (77777, 0, 1)], "doc_id long, quality int, toxic int")
    more = docs.select("doc_id", "text").union(spark.createDataFrame(rows, "doc_id long, text string"))
    got = T.toxic_spans(more, known)
    assert got.count() == len(corpus) + len(rows) and got.where("doc_id = 900").collect()[0]["spans"] == []
    assert not any(r["toxic"] for r in T.toxic_spans(docs, known.where("toxic = 0")).collect())
    assert T.without_toxic(docs, known.limit(0)).count() == len(corpus)
    assert T.without_toxic(docs, known.limit(0)).columns == docs.columns
    assert T.toxic_spans(nothing, known).collect() == []


@pytest.mark.parametrize(("n", "block"), [(3, 4), (300, 40), (500, 64)])
def test_top_k(spark, n, block):
    rng = np.random.default_rng(n)
    x = rng.normal(size=(n, 8)).round(1) + 4 * rng.integers(0, 3, (n, 1))
    x[1 % n] = x[0]
    rows = [(i, x[i].tolist(), "e") for i in range(n)] + [(0, x[0].tolist(), "e"), (9001, None, "n"), (None, x[0].tolist(), "n"), (9002, [float("nan")] * 8, "n"), (9003, [1.0], "short"), (9004, [], "n")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, block string")
    got = sorted((r["vec_id"], r["rank"], r["neighbour_id"], round(r["distance"], 9)) for r in topk.top_k(df, k=5, pivots=6, block=block).collect())
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    expected = []
    for i in range(n):
        near = sorted((j for j in range(n) if j != i), key=lambda j: (d[i, j], j))[:5]
        expected += [(i, k + 1, j, round(d[i, j], 9)) for k, j in enumerate(near)]
    assert [g[:2] + g[3:] for g in got] == [e[:2] + e[3:] for e in sorted(expected)]
    assert sum(g == e for g, e in zip(got, sorted(expected), strict=True)) >= 0.99 * len(got)


def test_top_k_of_some_queries(spark):
    """Of the stated queries alone, the same neighbours; crowded cells, and columns with the operator's own names."""
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=(300, 6)), np.ones((150, 6))]).astype(np.float32)
    rows = [(7 * i, x[i].tolist(), 1, 2, 3, 4) for i in range(len(x))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, cell int, cuts int, ids int, `v.x` int")
    got = defaultdict(list)
    for r in topk.top_k(df, k=4, pivots=5, block=32, every=100).collect():
        got[r["vec_id"]].append((r["rank"], r["neighbour_id"], round(r["distance"], 9)))
    e = x.astype(np.float64)
    d = np.sqrt(((e[:, None] - e[None]) ** 2).sum(axis=2))
    assert sorted(got) == [7 * i for i in range(len(x)) if 7 * i % 100 == 0]
    for q, near in got.items():
        i = q // 7
        expected = sorted((round(d[i, j], 9), 7 * j) for j in range(len(x)) if j != i)[:4]
        assert sorted(near) == [(k + 1, j, s) for k, (s, j) in enumerate(expected)]


def test_top_k_of_nothing(spark):
    assert topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []
