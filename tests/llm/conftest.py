import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, x long, p int, w string, c long, h string, key string, bin int, full int, rest string, found string, keep_id string, component long, epoch string, _row_ string, _id_ long, node string, k1 int"


def words(rng: random.Random, n: int, vocabulary: int = 3000) -> list[str]:
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def row(i, text, lang="en", source="src1"):
    return (i, text, lang, source, len(text or ""), "d", 1, 2, "w", 3, "h", "k", 4, 5, "r", "f", "z", 6, "e", "row", 7, "n", 8)


@pytest.fixture(scope="session")
def corpus():
    """Rows with copies, near copies, shared passages, odd texts, nulls, repeated rows and one very long text."""
    rng = random.Random(5)
    base = [words(rng, rng.randrange(60, 300)) for _ in range(40)]
    passage = words(rng, 70)
    texts = [" ".join(b) for b in base]
    for i in range(6):  # near copies, at several rates
        b = list(base[i])
        for k in range(0, len(b), 25 - 3 * i):
            b[k] = f"edit{i}x{k}"
        texts.append(" ".join(b))
    texts += [texts[3], texts[3], texts[7]]
    texts += [" ".join(words(rng, 120) + passage + words(rng, 90)) for _ in range(8)]
    texts += [texts[0] + " " + texts[1], "", "  \n ", "!!! ...", "one", "one", "two words", "ÄÖÜ straße 日本語 x", "DOWN with the Trash idiot people"]
    texts.append(" ".join(words(rng, 30000)))
    texts.append(" ".join(base[5] * 3))
    rows = [row(100 + i, t, ["en", "de", None][i % 3], ["src1", "src2", "src13", "odd", None][i % 5]) for i, t in enumerate(texts)]
    rows += [row(900, None), row(901, None), row(None, "no identifier here"), row(None, None), rows[2], rows[2], row(100, "another text under a known number")]
    return rows


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
