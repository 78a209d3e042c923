"""Mixing sources to target weights by hierarchical budgets over a domain - language - source tree."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm._tables import written

LEVELS = ("domain", "lang", "source")
#: Production weights: shares of siblings; a name that isn't listed has 1.
WEIGHTS: dict[str, dict[str, float]] = {
    "domain": {"domain0": 4.0, "domain1": 3.0, "domain2": 2.0, "domain3": 1.0},
    "lang": {"en": 5.0, "de": 2.0, "fr": 2.0, "es": 1.0},
    "source": {},
}


def domain_of(source: Column) -> Column:
    """The domain of a source: its number modulo 4; sources without a number are domain `other`."""
    number = F.regexp_extract(source, r"([0-9]{1,9})$", 1)
    return F.when(number != "", F.concat(F.lit("domain"), (F.try_to_number(number, F.lit("999999999")) % 4).cast("int").cast("string"))).otherwise("other")


def allocate(sizes: Mapping[tuple[str, ...], int], weights: Mapping[str, Mapping[str, float]], budget: float, epochs: int) -> dict[tuple[str, ...], float]:
    """Tokens of each leaf. A node's tokens go to its children by weight; what a child can't take (its leaves'
    sizes times epochs) goes to its siblings by weight, and only what all of them can't take, to the ancestors."""
    out: dict[tuple[str, ...], float] = {}

    def spread(path: tuple[str, ...], tokens: float, leaves: list[tuple[str, ...]]) -> None:
        depth = len(path)
        if depth == len(LEVELS):
            out[path] = tokens
            return
        below: dict[str, list[tuple[str, ...]]] = {}
        for leaf in sorted(leaves):
            below.setdefault(leaf[depth], []).append(leaf)
        room = {k: float(epochs * sum(sizes[x] for x in v)) for k, v in below.items()}
        share = {k: max(0.0, weights.get(LEVELS[depth], {}).get(k, 1.0)) for k in below}
        given, open_, left = dict.fromkeys(below, 0.0), sorted(below), min(tokens, sum(room.values()))
        while open_ and left > 0:
            total = sum(share[k] for k in open_)
            ask = {k: left * (share[k] / total if total else 1 / len(open_)) for k in open_}
            full = [k for k in open_ if ask[k] >= room[k]]
            if not full:
                given |= ask
                break
            for k in full:
                given[k] = room[k]
                left -= room[k]
                open_.remove(k)
        for k, v in below.items():
            spread((*path, k), given[k], v)

    spread((), float(budget), list(sizes))
    return out


def _prepared(docs: DataFrame, seed: int) -> DataFrame:
    source = F.coalesce(F.col("source").cast("string"), F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        domain_of(source).alias("domain"),
        F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"),
        source.alias("source"),
        F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit("[^ \\t\\n\\r]+")), F.lit(0)).cast("long").alias("n_tokens"),
        F.struct("*").alias("_row_"),
    ).where("doc_id is not null")


def _key(seed: int) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("full").cast("string"), F.col("doc_id").cast("string")))


def _selected(docs: DataFrame, weights, fraction: float, epochs: int, seed: int, whole: bool) -> DataFrame:
    spark = docs.sparkSession
    rows = _prepared(docs, seed)
    light = written(rows.drop("_row_"))  # words are counted once
    sizes = {(r["domain"], r["lang"], r["source"]): int(r["n"]) for r in light.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("n")).collect()}
    tokens = allocate(sizes, weights, fraction * sum(sizes.values()), epochs)
    plan = []
    for leaf, want in tokens.items():
        size = sizes[leaf]
        full = min(epochs, int(want // size)) if size else 0
        rest = want - full * size
        plan.append((*leaf, full, rest if full < epochs and rest > 1e-6 else 0.0))
    leaf = "domain string, lang string, source string, full int"
    goals = spark.createDataFrame(plan, leaf + ", rest double")
    # the cut in each leaf's last, partial epoch: sums by the first 12 bits of the shuffled order find the bin, its rows the key
    part = light.join(goals.where("rest > 0"), list(LEVELS)).withColumn("key", _key(seed)).withColumn("bin", F.substring("key", 1, 3))
    sums = part.groupBy(*LEVELS, "rest", "bin").agg(F.sum("n_tokens").alias("n"))
    after = F.sum("n").over(Window.partitionBy(*LEVELS).orderBy("bin"))
    hit = sums.withColumn("after", after).withColumn("before", F.col("after") - F.col("n")).where("before < rest and after >= rest")
    inside = part.join(hit.select(*LEVELS, "bin", "before"), [*LEVELS, "bin"])
    running = F.col("before") + F.sum("n_tokens").over(Window.partitionBy(*LEVELS, "bin").orderBy("key"))
    cuts = {(r["domain"], r["lang"], r["source"]): r["cut"] for r in inside.withColumn("run", running).where("run >= rest").groupBy(*LEVELS).agg(F.min("key").alias("cut")).collect()}
    # without a cut the rest is all of the epoch: no key is above "g"
    final = [(*p[:4], (cuts.get(p[:3], "g") if p[4] else "")) for p in plan]
    source = rows if whole else light
    chosen = source.join(spark.createDataFrame(final, leaf + ", cut string"), list(LEVELS))
    times = F.col("full") + F.when(_key(seed) <= F.col("cut"), 1).otherwise(0)
    return chosen.withColumn("epoch", F.explode(F.when(times > 0, F.sequence(F.lit(0), times - 1)).otherwise(F.array().cast("array<int>"))))


def mixture(docs: DataFrame, weights: Mapping[str, Mapping[str, float]] = WEIGHTS, fraction: float = 0.5, epochs: int = 4, seed: int = 7) -> DataFrame:
    """(doc_id, domain, lang, source, epoch, n_tokens): one row for each time that a document is taken.

    The budget is `fraction` of the corpus's tokens (runs of other than space, tab and line ends). A leaf whose
    budget is several times its size is taken whole in so many epochs, up to `epochs`; in its last one, documents
    come in an order shuffled by md5(seed, epoch, doc_id), up to the one that reaches the budget. Only the sums
    of the leaves, and one key for each, come to the driver; no text is shuffled.

    Null lang or source count as ''; sources without a number are domain `other`. Null and empty texts have no
    tokens; they come along where the order takes them. Very long texts count whole. Null doc_id: the row takes no part. Rows that share a
    doc_id are taken together. No documents: no rows. Other columns are ignored, whatever their names.
    """
    return _selected(docs, weights, fraction, epochs, seed, False).select("doc_id", *LEVELS, "epoch", "n_tokens")


def mixed(docs: DataFrame, weights: Mapping[str, Mapping[str, float]] = WEIGHTS, fraction: float = 0.5, epochs: int = 4, seed: int = 7) -> DataFrame:
    """The rows that mixture() takes, with all columns of docs, whatever their names; once for each epoch. Nulls, empty
    and very long texts, ties, repeated rows and no documents: as in mixture()."""
    return _selected(docs, weights, fraction, epochs, seed, True).select("_row_.*")
