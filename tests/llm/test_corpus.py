"""Mixing, packing, page differencing and the pipeline."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from textloom.llm import _text as tx
from textloom.llm import mixing, packing, page_diff


def test_mixture(docs, corpus, nothing):
    fraction, epochs, seed = 0.5, 4, 7
    rows = [(r[0], r[1], r[2] or "", r[3] or "") for r in corpus if r[0] is not None]
    domain = lambda s: {"src1": "domain1", "src2": "domain2", "src13": "domain1"}.get(s, "other")
    leaf = defaultdict(list)
    for i, t, lang, s in rows:
        leaf[domain(s), lang, s].append((i, len((t or "").split())))
    sizes = {k: sum(n for _, n in v) for k, v in leaf.items()}
    budget = mixing.allocate(sizes, mixing.WEIGHTS, fraction * sum(sizes.values()), epochs)
    assert abs(sum(budget.values()) - fraction * sum(sizes.values())) < 1e-6
    assert all(budget[k] <= epochs * sizes[k] + 1e-6 for k in sizes)
    expected = Counter()
    for k, members in leaf.items():
        left = budget[k]
        for e in range(epochs):
            if left >= sizes[k] - 1e-6 and sizes[k]:
                expected.update((i, e) for i, _ in members)
                left -= sizes[k]
                continue
            if left > 1e-6:
                key = lambda i, e=e: hashlib.md5(f"{seed}|{e}|{i}".encode()).hexdigest()
                run, cut = 0, "g"
                for h, n in sorted((key(i), n) for i, n in members):
                    run += n
                    if run >= left:
                        cut = h
                        break
                expected.update((i, e) for i, _ in members if key(i) <= cut)
            break
    got = Counter((r["doc_id"], r["epoch"]) for r in mixing.mixture(docs).collect())
    assert got == expected and got
    assert mixing.mixed(docs).columns == docs.columns and mixing.mixed(docs).count() == sum(got.values())
    assert mixing.mixture(nothing).collect() == [] and mixing.mixed(nothing).collect() == []


def test_shortage_goes_to_siblings_first():
    sizes = {("domain0", "en", "a"): 10, ("domain0", "de", "b"): 1000, ("domain1", "en", "c"): 1000}
    weights = {"domain": {"domain0": 1, "domain1": 1}, "lang": {"en": 9, "de": 1}}
    out = mixing.allocate(sizes, weights, 200, 1)
    assert out == {("domain0", "en", "a"): 10, ("domain0", "de", "b"): 90, ("domain1", "en", "c"): 100}


@pytest.mark.parametrize("shelf", [500, 4_000_000])
def test_packing(docs, corpus, nothing, shelf):
    window = 64
    got = packing.packed(docs, window=window, shelf=shelf).collect()
    sizes = Counter()
    for r in corpus:
        if r[0] is not None and (n := len(tx.plain_words(r[1]))):
            sizes[r[0], n] += 1
    per = defaultdict(list)
    fill = defaultdict(list)
    for r in got:
        per[r["doc_id"]].append((r["start_token"], r["end_token"]))
        fill[r["shelf"], r["window"]].append((r["offset"], r["offset"] + r["end_token"] - r["start_token"]))
    total = Counter()
    for (i, n), k in sizes.items():
        total[i] += n * k
    assert {i: sum(b - a for a, b in v) for i, v in per.items()} == dict(total)
    last = {s: max(w for t, w in fill if t == s) for s, _ in fill}
    for (s, w), spans in fill.items():
        spans.sort()
        assert spans[0][0] == 0 and all(x[1] == y[0] for x, y in zip(spans, spans[1:], strict=False))
        assert spans[-1][1] == window or (w == last[s] and spans[-1][1] < window)
    assert packing.packed(nothing).collect() == []


def test_related_documents_meet(spark):
    rng = random.Random(2)
    rows = []
    for f in range(30):
        b = [f"t{f}w{rng.randrange(400)}" for _ in range(100)]
        for c in range(3):
            v = list(b)
            v[rng.randrange(100)] = "edit"
            rows.append((f + 100 * c, " ".join(v)))
    got = packing.packed(spark.createDataFrame(rows, "doc_id long, text string"), window=300)
    order = [r["doc_id"] for r in sorted(got.collect(), key=lambda r: (r["shelf"], r["window"], r["offset"]))]
    order = [x for i, x in enumerate(order) if i == 0 or order[i - 1] != x]
    assert sum(a % 100 == b % 100 for a, b in zip(order, order[1:], strict=False)) >= 50


def test_neighbours_are_the_nearest(spark, docs, corpus):
    """Recall of the k nearest against brute force, of documents that share from a twentieth to four tenths of their
    n-grams too: at least 0.9 of those of a similarity of 0.1 or more."""
    rng = random.Random(9)
    rows = [(r[0], r[1]) for r in corpus if r[0] is not None and r[0] != 100]
    for f in range(20):
        b = [f"t{f}w{rng.randrange(4000)}" for _ in range(200)]
        for c, share in enumerate((20, 40, 60, 80, 110, 120)):
            at = rng.randrange(200 - share + 1)
            v = [f"t{f}c{c}w{rng.randrange(4000)}" for _ in range(200 - share)]
            rows.append((1000 + 10 * f + c, " ".join(v[: c * 10] + b[at : at + share] + v[c * 10 :])))
    sets = {}
    for i, t in rows:
        w = tx.plain_words(t)
        sets[i] = frozenset(tuple(w[j : j + 5]) for j in range(len(w) - 4)) or frozenset([tuple(w)] if w else [])
    jaccard = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    got = defaultdict(list)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    signed = df.mapInArrow(packing._digests(5), packing._SIGNED).cache()
    of = {}
    for r in signed.collect():
        if sets[r["doc_id"]]:
            of[r["x"]] = min(r["doc_id"], of.get(r["x"], r["doc_id"]))
    for r in packing.neighbours(signed, 4).collect():
        real = jaccard(of[r["x"]], of[r["y"]])
        assert real > 0 and abs(r["score"] - real) < 0.2
        got[of[r["x"]]].append(real)
    low = hit = total = 0
    for i in of.values():
        expected = sorted((s for j in of.values() if j != i and (s := jaccard(i, j)) >= 0.1), reverse=True)[:4]
        found = sorted(got[i], reverse=True)
        assert len(found) <= 4
        total += len(expected)
        hit += sum(a >= b - 1e-9 for a, b in zip(found, expected, strict=False))
        low += sum(s <= 0.4 for s in expected)
    assert low > 100 and hit >= 0.9 * total


@pytest.mark.parametrize("tile", [7, 2048])
def test_neighbours_under_a_crowded_key(spark, tile, monkeypatch):
    """Of a passage that hundreds of texts have, each text's nearest ones by all pairs are found, wherever they lie."""
    monkeypatch.setattr(packing, "TILE", tile, raising=False)
    rng = random.Random(6)
    base, more = ([f"{c}{rng.randrange(10**6)}" for _ in range(60)] for c in "bm")
    rows = [(i, " ".join(rng.sample([" ".join(more[k : k + 12]) for k in range(0, 60, 12)], 2) + base + [f"t{i}x{rng.randrange(10**6)}" for _ in range(20)])) for i in range(150)]
    signed = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).mapInArrow(packing._digests(5), packing._SIGNED).cache()
    sets = {r["x"]: (np.frombuffer(r["sketch"], np.uint8), set(r["keys"])) for r in signed.collect()}
    bins = {x: np.stack([s & 15, s >> 4]) for x, (s, _) in sets.items()}

    def score(a, b):
        share = ((bins[a] == bins[b]) & (bins[a] > 0)).sum() / (bins[a] | bins[b] > 0).sum()
        return max((share - 1 / 15) / (1 - 1 / 15), 1 / 256)

    expected = []
    for a in sets:
        near = sorted((-score(a, b), b) for b in sets if b != a and sets[a][1] & sets[b][1])[:4]
        expected += [(a, b, round(-s, 9)) for s, b in near]
    assert sorted((r["x"], r["y"], round(r["score"], 9)) for r in packing.neighbours(signed, 4).collect()) == sorted(expected)


@pytest.mark.parametrize("most", [40, 1 << 20])
def test_a_task_sends_the_nearest(most, monkeypatch):
    """Sets that meet under several keys of a task send each edge once and k of each set, which are the nearest of all."""
    monkeypatch.setattr(packing, "_EDGES", most, raising=False)
    rng, k = np.random.default_rng(3), 4
    base = rng.integers(0, 256, (30, packing.BINS // 2)).astype(np.uint8)
    base[:, :100] = base[0, :100]
    rows = sorted((g, x) for x in range(30) for g in rng.choice(12, 6, replace=False).tolist())
    zero = pa.array([0] * len(rows), pa.int32())
    columns = [pa.array([r[0] for r in rows], pa.int64()), zero, zero, zero, pa.array([r[1] for r in rows], pa.int64()), pa.array([base[r[1]].tobytes() for r in rows], pa.binary())]
    batch = pa.RecordBatch.from_arrays(columns, names=["g", "t", "u", "tile", "x", "sketch"])
    sent = [tuple(r.values()) for b in packing._index(k)(iter([batch.slice(0, 50), batch.slice(50)])) for r in b.to_pylist()]
    keys, every = defaultdict(set), packing.planes(base)
    for g, x in rows:
        keys[x].add(g)
    expected = []
    for x in keys:
        near = sorted((-float(packing._alike(every[x], every[y])), y) for y in keys if y != x and keys[x] & keys[y])[:k]
        expected += [(x, y, -s) for s, y in near]
    assert set(expected) <= set(sent)
    if most > 1000:
        assert sorted(sent) == sorted(expected)


def test_packing_divides_crowds(spark, monkeypatch):
    """A connected part, and a set, of more documents than one walk holds: every word is still in one piece."""
    monkeypatch.setattr(packing, "CROWD", 10)
    rng = random.Random(4)
    base = [f"w{rng.randrange(500)}" for _ in range(60)]
    texts = [" ".join(base[:40] + [f"t{i}x{k}" for k in range(20)]) for i in range(60)] + [" ".join(base)] * 40
    got = packing.packed(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), window=64, shelf=500).collect()
    words = Counter()
    for r in got:
        words[r["doc_id"]] += r["end_token"] - r["start_token"]
    assert words == {i: 60 for i in range(100)}


def test_walk():
    edges = [(1, 2, 5), (2, 3, 9), (2, 4, 1), (3, 4, 2), (7, 8, 1)]
    assert packing.walk(edges) == [1, 2, 3, 4, 7, 8]
    assert packing.walk([]) == []


def lcs(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


@pytest.mark.parametrize("limit", [0, 1 << 28])
def test_common_lines(limit, monkeypatch):
    rng = random.Random(limit)
    if not limit:  # always by halves
        source = page_diff._aligned.__code__
        monkeypatch.setattr(page_diff._aligned, "__code__", source.replace(co_consts=tuple(16 if c == 1 << 28 else c for c in source.co_consts)))
    for _ in range(300):
        a, b = ([rng.randrange(5) for _ in range(rng.randrange(16))] for _ in range(2))
        c = page_diff.common(a, b)
        rest = iter(b)
        assert c == sorted(set(c)) and len(c) == lcs(a, b) and all(a[i] in rest for i in c)


def test_common_lines_of_long_pages(monkeypatch):
    """Which lines are common doesn't depend on how many vectors are held at once."""
    rng = random.Random(6)
    for _ in range(100):
        a, b = ([rng.randrange(4) for _ in range(rng.randrange(40))] for _ in range(2))
        whole = page_diff.common(a, b)
        monkeypatch.setattr(page_diff._Rows, "LEAST", 2)
        assert page_diff.common(a, b) == whole
        monkeypatch.undo()
    long = [rng.randrange(1000) for _ in range(3000)]
    other = [x for x in long if x % 7] + [5000]
    assert [long[i] for i in page_diff.common(long, other)] == other[:-1]


def test_lines_of():
    page = "<head><title>T</title></head><body><script>x<p>y</script><!-- c --><p>One &amp; <b>two</b><br>three<p> \n <li>four\nfive</li><style>z"
    assert page_diff.lines_of(page) == ["One & two", "three", "four five"]
    assert page_diff.lines_of(None) == page_diff.lines_of("") == []


def test_page_differencing(spark):
    page = lambda *x: "<p>menu</p>" + "".join(f"<p>{t}</p>" for t in x) + "<div>foot</div>"
    rows = [
        (1, "http://A.org/x/1", page("a"), "c"), (2, "http://a.org/x/2?q", page("b", "a"), "c"), (3, "https://a.org/y", page("z"), "c"), (4, "http://solo.org/", page("s"), "c"), (5, None, page("n"), "c"), (6, "http://a.org/z", None, "c"),
        (7, "http://twin.org/a", page("t"), "c"), (8, "http://twin.org/b", page("t"), "c"), (None, "http://twin.org/c", page("u"), "c"), (1, "http://A.org/x/1", page("a"), "c"), (10, "nonsense", "", "c"),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, lines string")
    got = {r["page_id"]: (r["pair_id"], r["n_lines"], r["n_removed"], r["text"]) for r in page_diff.main_text(df).collect()}
    assert page_diff.main_text(df).count() == len(rows)
    assert got == {
        1: (2, 3, 3, ""), 2: (1, 4, 3, "b"), 3: (2, 3, 2, "z"), 4: (None, 3, 0, "menu\ns\nfoot"), 5: (None, 3, 0, "menu\nn\nfoot"), 6: (3, 0, 0, ""),
        7: (None, 3, 0, "menu\nt\nfoot"), 8: (None, 3, 2, "t"), None: (8, 3, 2, "u"), 10: (None, 0, 0, ""),
    }
    assert page_diff.main_text(df.limit(0)).collect() == []


@pytest.mark.parametrize("parts", ["1", "3", "16"])
def test_pages_of_hot_hosts(spark, parts):
    """Pairs over the borders of ranges are those that one list of all pages gives."""
    rng = random.Random(int(parts))
    rows = []
    for i in range(60):
        host = "hot.org" if i % 3 else f"h{i % 4}.org"
        lines = [f"menu {host}", *(f"line {rng.randrange(12)}" for _ in range(rng.randrange(1, 6))), "foot"]
        rows.append((i, f"http://{host}/{'abc'[rng.randrange(3)]}/{rng.randrange(20)}", "".join(f"<p>{x}</p>" for x in lines), 1, "x", 2))
    df = spark.createDataFrame(rows, "page_id long, url string, html string, part int, host string, spot int")
    now = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = {r["page_id"]: (r["pair_id"], r["text"]) for r in page_diff.main_text(df).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", now)
    order = sorted(rows, key=lambda r: (r[1].split("/")[2], "/" + r[1].split("/", 3)[3], r[0]))
    for k, r in enumerate(order):
        path, lines = "/" + r[1].split("/", 3)[3], page_diff.lines_of(r[2])
        best, score = None, -1
        for other in ([order[k - 1]] if k else []) + order[k + 1 : k + 2]:
            there = "/" + other[1].split("/", 3)[3]
            n = len(page_diff.commonprefix([path, there]))
            if other[1].split("/")[2] == r[1].split("/")[2] and page_diff.lines_of(other[2]) != lines and n > score:
                best, score = other, n
        gone = set(page_diff.common(lines, page_diff.lines_of(best[2]))) if best else set()
        assert got[r[0]] == (best[0] if best else None, "\n".join(x for i, x in enumerate(lines) if i not in gone))


def test_pipeline(spark, tmp_path, docs, corpus):
    import corpus_pipeline

    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rng = random.Random(3)
    labels = [(r[0], 1, 0) for r in corpus if r[0] is not None]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, str(tmp_path))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns, name
            out.write.parquet(f"{tmp_path}/{k}")
            now = spark.read.parquet(f"{tmp_path}/{k}")
    staged = sorted(map(tuple, out.collect()))
    assert sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).collect())) == staged and staged
    assert rng


def test_stages_decide(spark, tmp_path):
    """Each stage against brute force on its own input: toxic documents, copies, near copies, the mixture and every
    word of what is left; labels that are null or of unknown documents don't count."""
    import corpus_pipeline

    rng = random.Random(12)
    base = [[f"v{rng.randrange(900)}" for _ in range(80)] for _ in range(160)]
    rows, labels, toxic = [], [], set()
    for i, w in enumerate(base):
        w = list(w)
        if i % 4 == 0:
            toxic.add(i)
            for k in range(5):
                w[rng.randrange(80)] = ["moron", "scum", "trash"][k % 3]
        rows.append((i, " ".join(w)))
        labels.append((i, i % 2, int(i % 4 == 0)))
    labels += [(None, 1, 1), (3, None, None), (9999, 1, 1)]
    rows += [(1000 + i, rows[i][1]) for i in (1, 2, 3)] + [(2000 + i, rows[i][1] + " tail") for i in (5, 6)] + [(3000, None), (3001, ""), (None, "v1 v2")]
    docs = spark.createDataFrame([(i, t, "en", "src1", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    ids = lambda df: Counter(r["doc_id"] for r in df.collect())
    all_ids, stages = Counter(i for i, _ in rows), dict(corpus_pipeline.STAGES)
    clean = stages["toxicity"](spark, docs, str(tmp_path)).cache()
    assert ids(clean) == all_ids - Counter(toxic)
    exact = stages["exact_dedup"](spark, clean, str(tmp_path)).cache()
    assert ids(exact) == ids(clean) - Counter([1001, 1002, 1003])
    near = stages["ngram_join"](spark, exact, str(tmp_path)).cache()
    assert ids(near) == ids(exact) - Counter([2005, 2006])
    mixed = stages["mixing"](spark, near, str(tmp_path)).cache()
    expected = Counter(r["doc_id"] for r in mixing.mixture(near).collect())
    assert ids(mixed) == expected and expected
    text = dict(rows)
    out = Counter()
    for r in stages["packing"](spark, mixed, str(tmp_path)).collect():
        out[r["doc_id"]] += r["end_token"] - r["start_token"]
    assert out == Counter({i: n * len(tx.plain_words(text[i])) for i, n in expected.items() if i is not None and tx.plain_words(text[i])})


def test_pipeline_of_nothing(spark, tmp_path, nothing):
    import corpus_pipeline

    nothing.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
