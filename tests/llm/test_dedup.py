"""Exact, near, substring and suffix-array dedup against brute force."""

import random
import time
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from textloom.llm import _text as tx
from textloom.llm import exact_dedup, ngram_join, substring_dedup, suffix_dedup
from textloom.llm._tables import components


def listed(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("fan", [2, 8])
def test_exact(docs, corpus, fan):
    groups = defaultdict(list)
    for r in corpus:
        if r[0] is not None:
            groups[r[1]].append(r[0])
    expected = [(i, min(g)) for g in groups.values() for i in sorted(g)[1:]]
    assert listed(exact_dedup.copies(docs, fan).select("doc_id", "keep_id")) == sorted(expected, key=str)


def test_exact_kept(docs, corpus, nothing):
    kept = exact_dedup.without_copies(docs)
    assert kept.columns == docs.columns
    least = {}
    for r in corpus:
        if r[0] is not None:
            least[r[1]] = min(r[0], least.get(r[1], 10**9))
    expected = [(i, t) for t, i in least.items()] + [(None, "no identifier here"), (None, None)]
    assert listed(kept.select("doc_id", "text")) == sorted(expected, key=str)
    assert exact_dedup.copies(nothing).collect() == [] and exact_dedup.without_copies(nothing).collect() == []


def test_exact_kept_of_one_id(spark):
    """A doc_id that stands for two texts, each of them repeated, keeps a row of both."""
    rows = [(5, "text a"), (5, "text a"), (5, "text b"), (5, "text b"), (6, "text b"), (7, "text c"), (5, None), (5, None)]
    kept = exact_dedup.without_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert listed(kept) == sorted([(5, "text a"), (5, "text b"), (7, "text c"), (5, None)], key=str)


def grams(text, n=5):
    w = tx.plain_words(text)
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) or frozenset([tuple(w)] if w else [])


def near_expected(corpus, least):
    ids = defaultdict(set)
    for r in corpus:
        if r[0] is not None and grams(r[1]):
            ids[grams(r[1])].add(r[0])
    points = [(min(i), g) for g, i in ids.items()]
    out = [(min(v), i, 1.0) for v in ids.values() for i in sorted(v)[1:]]
    for a in range(len(points)):
        for b in range(a):
            x, y = points[a][1], points[b][1]
            j = len(x & y) / len(x | y)
            if j >= least - 1e-12:
                out.append((*sorted((points[a][0], points[b][0])), j))
    return sorted(out, key=str)


@pytest.mark.parametrize("least", [0.3, 0.45, 0.8])
def test_near(docs, corpus, least):
    got = listed(ngram_join.similar_pairs(docs, least=least))
    assert got == near_expected(corpus, least) and len(got) > 4


@pytest.mark.parametrize("tile", [3, 2048])
def test_near_classes(docs, corpus, nothing, tile, monkeypatch):
    """One row for each document, with the class and the number of links that all pairs give; by tiles too."""
    monkeypatch.setattr(ngram_join, "TILE", tile)
    sets = {(r[0], grams(r[1])) for r in corpus if r[0] is not None}
    linked = lambda x, y: x and y and len(x & y) / len(x | y) >= 0.4 - 1e-12
    group = {s: s for s in sets}

    def top(s):
        while group[s] != s:
            s = group[s]
        return s

    links = defaultdict(int)
    for s in sets:
        for t in sets:
            if s != t and linked(s[1], t[1]):
                links[s] += 1
                group[top(s)] = top(t)
    least = {}
    for s in sets:
        least[top(s)] = min(s[0], least.get(top(s), s[0]))
    got = listed(ngram_join.similar_classes(docs))
    assert got == sorted(((s[0], least[top(s)], links[s]) for s in sets), key=str) and sum(links.values()) > 20
    assert listed(ngram_join.similar_pairs(docs)) == near_expected(corpus, 0.4)
    assert ngram_join.similar_classes(nothing).collect() == []


def test_near_kept(docs, corpus, nothing):
    kept = ngram_join.without_similar(docs)
    assert kept.columns == docs.columns
    parent = {r[0]: r[0] for r in corpus}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b, _ in near_expected(corpus, 0.4):
        x, y = sorted((top(a), top(b)))
        parent[y] = x
    expected = sorted(str((r[0], r[1])) for r in corpus if r[0] is None or top(r[0]) == r[0])
    assert sorted(str(tuple(r)) for r in kept.select("doc_id", "text").collect()) == expected
    assert ngram_join.similar_pairs(nothing).collect() == [] and ngram_join.without_similar(nothing).collect() == []


@pytest.mark.parametrize("least", [0.2, 0.5, 0.85])
def test_metric_join(least):
    rng = np.random.default_rng(1)
    pool = rng.integers(1, 2**62, 4000).astype(np.uint64)
    centres = [rng.choice(pool, 60, replace=False) for _ in range(12)]
    sets = [np.unique(np.concatenate([c[rng.random(60) < rng.choice([0.5, 0.9, 1.0])], rng.choice(pool, rng.integers(1, 12))])) for c in centres for _ in range(25)]
    expected = {(i, j) for j in range(len(sets)) for i in range(j) if len(np.intersect1d(sets[i], sets[j])) / len(np.union1d(sets[i], sets[j])) >= least - 1e-12}
    assert set(ngram_join.metric_join(sets, least)) == expected and expected


def test_near_beside_copies(spark):
    """Copies of a text don't count its n-grams several times: what else it shares with others still links it."""
    rng, rows = random.Random(3), []
    words = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    for k in range(24):
        left, right = words(42), words(64)
        texts = [left + words(60), *[left + right] * 5, words(34) + right]
        rows += [(100 * k + i, " ".join(t)) for i, t in enumerate(texts)]
    got = listed(ngram_join.similar_pairs(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)))
    assert got == near_expected(rows, 0.4) and len(got) > 24


def test_crowd_of_near_copies():
    """A crowd, each member of which has n-grams of its own, is counted by what its members share, in no more than seconds."""
    rng = np.random.default_rng(2)
    base = rng.integers(1, 2**62, 300).astype(np.uint64)
    sets = [np.unique(np.concatenate([base[rng.random(300) < 0.85], rng.integers(1, 2**62, 200).astype(np.uint64)])) for _ in range(1500)]
    began = time.process_time()
    pairs = ngram_join.metric_join(sets, 0.2)
    assert time.process_time() - began < 20 and len(pairs) > 10**6
    some = range(0, 1500, 100)
    expected = {(i, j) for j in some for i in some if i < j and len(np.intersect1d(sets[i], sets[j])) >= 0.2 * len(np.union1d(sets[i], sets[j])) - 1e-9}
    assert {p for p in pairs if p[0] % 100 == p[1] % 100 == 0} == expected


@pytest.mark.parametrize("least", [0.2, 0.6])
def test_close_of_two_sides(least, monkeypatch):
    """Sets of two tiles: each pair of a set of one with a set of the other, once; by small blocks too."""
    rng = np.random.default_rng(4)
    pool = rng.integers(1, 2**62, 150).astype(np.uint64)
    sets = [np.unique(rng.choice(pool[:40] if k % 3 else pool, 30)) for k in range(200)]
    side = rng.random(200) < 0.4
    full = ngram_join.metric_join(sets, least)
    for cells in (300, 1 << 21):
        monkeypatch.setattr(ngram_join, "_CELLS", cells)
        got = [(a, b, v) for i, j, s in ngram_join._close(sets, least, side) for a, b, v in zip(i.tolist(), j.tolist(), s.tolist(), strict=True)]
        assert sorted(got) == sorted((*p, v) for p, v in full.items() if side[p[0]] != side[p[1]]) and got


def repeated(corpus, least):
    """Covered word ranges by brute force: windows that occur at two places of distinct texts, or twice in one."""
    texts = {}
    for r in corpus:
        if r[0] is not None:
            texts.setdefault((r[0], tuple(tx.plain_words(r[1]))), 0)
            texts[r[0], tuple(tx.plain_words(r[1]))] += 1
    copies, seen = defaultdict(int), defaultdict(set)
    for (i, w), n in texts.items():
        copies[w] += n
        for k in range(len(w) - least + 1):
            seen[w[k : k + least]].add((w, k))
    out = []
    for i, w in texts:
        if len(w) < least:
            continue
        if copies[w] > 1:
            out.append((i, 0, len(w)))
            continue
        starts = [k for k in range(len(w) - least + 1) if len(seen[w[k : k + least]]) > 1]
        while starts:
            a = z = starts.pop(0)
            while starts and starts[0] == z + 1:
                z = starts.pop(0)
            out.append((i, a, z + least))
    return sorted(out, key=str)


@pytest.mark.parametrize("least", [12, 50])
def test_substring_and_suffix(docs, corpus, least):
    expected = repeated(corpus, least)
    assert len(expected) > 10
    assert listed(suffix_dedup.suffix_repeats(docs, least)) == expected
    found = substring_dedup.repeated_passages(docs, least)
    assert listed(found.select("doc_id", "start_word", "end_word")) == expected
    assert all(r["longest"] >= least and r["longest"] <= r["end_word"] - r["start_word"] for r in found.collect())


def test_repeats_of_nothing(nothing):
    assert substring_dedup.repeated_passages(nothing).collect() == [] and suffix_dedup.suffix_repeats(nothing).collect() == []


def test_collection_arrays():
    rng = np.random.default_rng(2)
    for _ in range(30):
        length = rng.integers(1, 12, rng.integers(1, 9))
        symbols = rng.integers(0, 3, length.sum())
        place, lcp = suffix_dedup.collection_arrays(symbols, length)
        ends = np.repeat(np.cumsum(length), length)
        suffixes = [tuple(symbols[i : ends[i]]) for i in range(len(symbols))]
        order = sorted(range(len(symbols)), key=lambda i: place[i])
        assert [suffixes[i] for i in order] == sorted(suffixes)
        for a, b in zip(order, order[1:], strict=False):
            n = 0
            while n < min(len(suffixes[a]), len(suffixes[b])) and suffixes[a][n] == suffixes[b][n]:
                n += 1
            assert lcp[place[b]] == n


def test_collection_with_weights():
    """A symbol that counts as five gives the order of its five symbols in a row, and their common prefixes."""
    rng = np.random.default_rng(6)
    for _ in range(30):
        parts = [(rng.integers(0, 3, rng.integers(0, 6)), rng.integers(0, 3, rng.integers(0, 6))) for _ in range(rng.integers(1, 9))]
        short = [[*a, 3, *b] for a, b in parts]
        place, lcp = suffix_dedup.collection_arrays(np.concatenate(short), np.array([len(x) for x in short]), np.array([1, 1, 1, 5]))
        suffixes = {p: sum(([s] * (5 if s == 3 else 1) for s in x[i:]), []) for x, base in zip(short, np.cumsum([0, *map(len, short)]), strict=False) for i, p in enumerate(place[base : base + len(x)])}
        ranks = sorted(suffixes)
        assert [suffixes[r] for r in ranks] == sorted(suffixes.values())
        for a, b in zip(ranks, ranks[1:], strict=False):
            n = 0
            while n < min(len(suffixes[a]), len(suffixes[b])) and suffixes[a][n] == suffixes[b][n]:
                n += 1
            assert lcp[b] == n


@pytest.mark.parametrize(("lot", "anchors"), [(5, 60), (4096, 60), (4096, 8000)])
def test_neighbours_in_a_partition(lot, anchors, monkeypatch):
    """Windows that pieces of an anchor share, wherever lots and batches end; work is in proportion to the pieces."""
    monkeypatch.setattr(suffix_dedup, "LOT", lot)
    rng, least, k = np.random.default_rng(8), 50, 25
    rows = []
    for h in range(anchors):
        base = rng.integers(1, 2**62, 75).astype(np.uint64)
        for _ in range(rng.integers(2, 10)):
            a, z, x = rng.integers(0, 26), rng.integers(50, 76), base.copy()
            x[rng.choice(np.r_[:25, 50:75], rng.integers(0, 3))] = rng.integers(1, 2**62)
            a = min(a, z - least)
            rows.append((h - 30, len(rows), a, 25 - a, x[a:z]))
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
    columns = zip(*((h, i, 0, a, lead, x[:lead].tobytes() + x[lead + k :].tobytes()) for h, i, a, lead, x in rows), strict=True)
    batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["h", "doc_id", "c", "start", "lead", "words"])
    began = time.process_time()
    found = list(suffix_dedup._neighbours(least)(batch.slice(a, 17 if anchors < 100 else 10000) for a in range(0, len(rows), 17 if anchors < 100 else 10000)))
    assert time.process_time() - began < 8
    seen = defaultdict(set)
    for h, i, a, _, x in rows:
        for j in range(len(x) - least + 1):
            seen[h, x[j : j + least].tobytes()].add((i, a + j))
    expected = {p for v in seen.values() if len(v) > 1 for p in v}
    got = [tuple(r.values()) for b in found for r in b.to_pylist()]
    assert sorted((i, s) for i, _, a, e in got for s in range(a, e - least + 1)) == sorted(expected) and len(expected) > anchors


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 60)] + [(100, 101), (101, 100), (7, 7), (None, 3)], "a long, b long")
    got = {r["node"]: r["component"] for r in components(edges).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100}


def test_merged_runs():
    rng = np.random.default_rng(4)
    for _ in range(50):
        sides = []
        for _ in range(2):
            d = np.unique(rng.integers(0, 30, rng.integers(0, 20))).astype(f"S{exact_dedup._WIDTH}")
            d.sort()
            sides.append((d, rng.integers(0, 100, len(d))))
        (digest, ids), lost = exact_dedup.merged(*sides)
        known = defaultdict(list)
        for d, i in zip(*(np.concatenate(x) for x in zip(*sides, strict=True)), strict=True):
            known[d].append(i)
        assert digest.tolist() == sorted(known) and ids.tolist() == [min(known[d]) for d in sorted(known)]
        assert sorted(zip(*lost, strict=True)) == sorted((d, max(v)) for d, v in known.items() if len(v) > 1)


def test_kept_with_odd_columns(spark):
    """Columns with dots and the names that the operators use themselves come through."""
    rows = [(1, "a b c d e f g", 1, 2, 3, 4, 5), (2, "a b c d e f g", 1, 2, 3, 4, 5), (3, "one more text", 1, 2, 3, 4, 5), (4, None, 1, 2, 3, 4, 5), (5, "", 1, 2, 3, 4, 5), (None, "", 1, 2, 3, 4, 5)]
    names = ["doc_id", "text", "a.b", "_gone_", "_same_", "digest", "_row_"]
    df = spark.createDataFrame(rows, ", ".join(f"`{n}` {t}" for n, t in zip(names, ["long", "string", *["int"] * 5], strict=True)))
    for f in (exact_dedup.without_copies, ngram_join.without_similar):
        out = f(df)
        assert out.columns == names
        assert sorted(str(r[0]) for r in out.collect()) == ["1", "3", "4", "5", "None"]
