"""Settings, aliases, option rules, numbered files, the index cache and plans of the operators."""

import pytest
from pyspark.sql import functions as F

from textloom.functions.article import Options
from textloom.operators import articles as A
from textloom.operators import relations as R
from textloom.plans import queries as Q
from textloom.sources import index_cache, settings, sinks
from textloom.streaming import arriving

SF = "/root/testdata/sf0.001"


def executed(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_rendered_once(spark):
    """One scan in Python, above the exchange that spreads the rows, though null output is filtered."""
    plan = executed(A.rendered(Q.synthesized(spark, SF), Options()))
    assert plan.count("ArrowEvalPython") == 1
    assert plan.index("ArrowEvalPython") < plan.index("Exchange")


def test_walks_have_flat_plans(spark):
    edges = spark.createDataFrame([(f"c{i}", f"c{i + 1}") for i in range(12)], "parent string, child string")
    root = spark.createDataFrame([("c0",)], "name string")
    deep = R.reachable(edges, root, 10)
    assert deep.count() == 11 and executed(deep).count("Join") == 0
    assert R.reachable(edges, root, 0).count() == 1
    members = spark.createDataFrame([("c1", "p"), ("c1", "q")], "category string, page string")
    tree = {r["name"]: (r["parent"], r["depth"], r["page_count"], r["cached"]) for r in R.counted_tree(edges, members, root, 2).collect()}
    assert tree == {"c0": (None, 0, 0, True), "c1": ("c0", 1, 2, True), "c2": ("c1", 2, 0, True)}


def test_settings(tmp_path):
    assert settings.Settings(dump_expiry_days=0, category_expiry_days=900, default_depth=11, default_format="xml") == settings.Settings(1, 90, default_depth=10)
    path = tmp_path / "a" / "config.yml"
    own = settings.Settings(dump_expiry_days=12, default_format="json", default_depth=2)
    assert own.save(path) and settings.Settings.load(path) == own and not own.save(path, force=False)
    path.write_text("cache:\n  dump_expiry_days: 99\n  directory: '/x y'\ndefaults:\n  format: json\n  depth: 3\n")
    assert settings.Settings.load(path) == settings.Settings(99, 7, "/x y", "json", 3)
    path.write_text("\tno mapping at all")
    assert settings.Settings.load(path) == settings.Settings.load(tmp_path / "none") == settings.Settings()


def test_alias_file(tmp_path):
    path = tmp_path / "a.yml"
    path.write_text('# c\n"Early life":\n  - Youth\n  - "Life: early"\nPlot: [Synopsis, \'Story\']\nOne: Single # why\n')
    assert settings.aliases(path) == (("Early life", ("Youth", "Life: early")), ("Plot", ("Synopsis", "Story")), ("One", ("Single",)))
    path.write_text("- a\n- b\n")
    assert settings.aliases(path) == settings.aliases(None) == settings.aliases(tmp_path / "none") == ()


@pytest.mark.parametrize(
    "options",
    [
        {}, {"source": "x", "lang": "en"}, {"source": "x", "articles": "A"}, {"source": "x", "from_category": "C"}, {"lang": "en", "articles": "A", "from_category": "C"}, {"lang": "EN"}, {"lang": "e"}, {"lang": "en_us"},
        {"lang": "en", "depth": -1}, {"lang": "en", "dry_run": True}, {"lang": "en", "yes": True}, {"lang": "en", "file_size": -1}, {"lang": "en", "modes": ("category", "summary")}, {"lang": "en", "modes": ("metadata", "sections")},
        {"lang": "en", "modes": ("section-stats", "summary")}, {"lang": "en", "modes": ("nonsense",)}, {"lang": "en", "options": Options(format="xml")}, {"lang": "en", "options": Options(show_matched_sections=True)},
    ],
)
def test_options_that_do_not_go_together(options):
    with pytest.raises(settings.OptionError):
        settings.validated(**options)


def test_options_that_do():
    o = Options(format="json", sections=("A",), mode="sections", show_matched_sections=True)
    assert settings.validated(o, lang="zh-yue") is o and settings.validated(source="d.xml") == Options()
    assert settings.validated(lang="simple", from_category="C", depth=3, dry_run=True, yes=True)
    assert settings.titles(" a, ,b ") == ["a", "b"] and settings.titles(None) == []


@pytest.mark.parametrize("json", [False, True])
def test_rotated_files(spark, tmp_path, json):
    rows = spark.createDataFrame([(f"{i:03}", f"record {i:03}" if i % 7 else " \n ") for i in range(200)] + [("x", None)], "title string, output string").repartition(5)
    end = "jsonl" if json else "txt"
    names = sinks.write_rotated(rows, f"{tmp_path}/out", "base", file_mb=400 / sinks.MB, json=json)
    kept = [f"record {i:03}" for i in range(200) if i % 7]
    read = [(tmp_path / "out" / n).read_text().splitlines() for n in names]
    assert names == [f"base-{k}.{end}" for k in range(1, len(names) + 1)] and sum(read, []) == kept
    assert all(390 <= sum(len(x) + 1 for x in part) <= 410 for part in read[:-1])
    assert sinks.write_rotated(rows, f"{tmp_path}/one", "base", file_mb=0, json=json) == [f"base.{end}"]
    assert (tmp_path / "one" / f"base.{end}").read_text().splitlines() == kept
    assert sinks.write_rotated(rows.where("output is null"), f"{tmp_path}/none", "base") == []
    with pytest.raises(sinks.SinkError):
        sinks.write_rotated(rows, "nosuchscheme://x/y", "base")


def test_index_cache(spark, tmp_path):
    index, cache = tmp_path / "index.txt", f"{tmp_path}/cache"
    index.write_text("10:1:One\n10:2:Two: b\n90:3:Three\n")
    assert not index_cache.valid(spark, str(index), cache)
    assert sorted(r["title"] for r in index_cache.load(spark, str(index), cache).collect()) == ["One", "Three", "Two: b"]
    assert index_cache.valid(spark, str(index), cache) and index_cache.stats(spark, cache).first()["entries"] == 3
    index.write_text("10:1:One\n")
    assert not index_cache.valid(spark, str(index), cache)
    assert index_cache.load(spark, str(index), cache).count() == 1
    assert not index_cache.valid(spark, f"{tmp_path}/gone.txt", cache)


def test_cached_categories(spark):
    cache = spark.createDataFrame([("A", "2024-06-14"), ("B", "2024-01-01"), ("C", "2024-06-15")], "name string, at string").select("name", F.col("at").cast("timestamp").alias("cached_at"))
    edges = spark.createDataFrame([("A", "B"), ("A", "C")], "parent string, child string")
    members = spark.createDataFrame([("A", "p"), ("B", "q")], "category string, page string")
    names = spark.createDataFrame([("Category:A",), ("B",), ("category: C ",), ("D",)], "name string")
    got = {r["name"]: (r["pages"], r["subcats"]) for r in R.cached(cache, edges, members, names, "2024-06-15", 7).collect()}
    assert got == {"A": (["p"], ["B", "C"]), "C": ([], [])}
    assert R.expired_count(cache, "2024-06-15", 7).first()["removed"] == 1
    stats = R.cache_stats(cache).first()
    assert stats["entries"] == 3 and str(stats["oldest"])[:10] == "2024-01-01"


def test_late_arrivals_are_left_out(spark, tmp_path):
    def put(*times):
        spark.createDataFrame([(t,) for t in times], "t string").select(F.col("t").cast("timestamp").alias("ts")).write.mode("append").parquet(f"{tmp_path}/in")

    def run():
        rows = spark.readStream.schema("ts timestamp").parquet(f"{tmp_path}/in")
        return sorted((str(r["start"])[:10], r["count"]) for r in arriving.run_to(arriving.arrivals(rows, "ts"), f"{tmp_path}/out", f"{tmp_path}/state").collect())

    put("2024-01-01 10:00", "2024-01-01 11:00", "2024-01-02 23:00")
    assert run() == [("2024-01-01", 2)]
    put("2024-01-01 12:00", "2024-01-04 10:00")  # the first is too late
    assert run() == [("2024-01-01", 2), ("2024-01-02", 1)]
