"""Sources, sinks, relations, streaming and registered queries on Spark."""

import bz2

import duckdb
import pytest

import __spark_entry__
from textloom.functions import columns as C
from textloom.functions import udfs as U
from textloom.functions.article import Options
from textloom.operators import articles as A
from textloom.operators import relations as R
from textloom.plans import queries as Q
from textloom.sources import dumps as D
from textloom.streaming import arriving

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def con():
    c = duckdb.connect()
    for t in Q.TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(str([round(r[i], 6) if isinstance(r[i], float) else r[i] for i in order]) for r in rows)


@pytest.mark.parametrize("name", sorted(Q.ORACLE_SQL))
def test_query(spark, con, name):
    got = __spark_entry__.queries()[name](spark, SF)
    expected = con.execute(Q.ORACLE_SQL[name])
    assert rows_of(got.columns, [tuple(r) for r in got.collect()]) == rows_of([d[0] for d in expected.description], expected.fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0 and __spark_entry__.queries()["random_articles"](spark, SF).count() == 25


def page(i, title, text):
    return f'<page><title>{title}</title><ns>0</ns><id>{i}</id><revision><id>9{i}</id><text xml:space="preserve">{text}</text></revision></page>\n'


@pytest.fixture(scope="session")
def dump(tmp_path_factory):
    """A multistream dump and its index."""
    folder = tmp_path_factory.mktemp("dump")
    parts = ["<mediawiki>\n<siteinfo/>\n", page(1, "One", "A &lt;b&gt; [[Category:X]]\n x") + page(2, "Two", "#REDIRECT [[One]]"), page(3, "Three", "== H ==\ntext<!-- &lt;page&gt; -->") + page(4, "Talk:Four", "x"), "</mediawiki>"]
    packed = [bz2.compress(p.encode()) for p in parts]
    at = [len(packed[0]), len(packed[0]) + len(packed[1])]
    (folder / "d.xml.bz2").write_bytes(b"".join(packed))
    (folder / "d.xml").write_text("".join(parts))
    (folder / "index.txt").write_text(f"{at[0]}:1:One\n{at[0]}:2:Two\n\n{at[1]}:3:Three\n{at[1]}:4:Talk:Four\nbroken\n")
    return folder


@pytest.mark.parametrize("name", ["d.xml.bz2", "d.xml"])
def test_dump(spark, dump, name):
    pages = D.pages(spark, f"{dump}/{name}")
    assert sorted((r["page_id"], r["title"]) for r in pages.collect()) == [(1, "One"), (2, "Two"), (3, "Three"), (4, "Talk:Four")]
    kept = {r["title"]: r["text"] for r in A.main_pages(pages).collect()}
    assert kept["One"] == "A <b> [[Category:X]]\n x" and set(kept) == {"One", "Three"}
    assert {r["title"] for r in A.main_pages(pages, keep_redirects=True).collect()} == {"One", "Two", "Three"}


def test_directory_and_errors(spark, dump):
    assert D.pages(spark, str(dump)).count() == 8
    with pytest.raises(D.DumpError):
        D.pages(spark, "dump.zip")
    assert D.files(spark, str(dump), "*.xml*").count() == 2
    problems = {r["path"].rsplit("/", 1)[1]: r["problem"] for r in D.bz2_checked(spark, str(dump)).collect()}
    assert problems == {"d.xml.bz2": None, "d.xml": "not bzip2", "index.txt": "not bzip2"}


def test_random_access(spark, dump):
    index = D.index(spark, f"{dump}/index.txt")
    assert index.count() == 4
    titles = spark.createDataFrame([("Three",), ("Talk:Four",), ("Nope",)], "title string")
    found = D.articles(spark, f"{dump}/d.xml.bz2", index, titles)
    assert sorted((r["title"], r["page_id"]) for r in found.collect()) == [("Talk:Four", 4), ("Three", 3)]
    assert [r["title"] for r in R.missing_titles(titles, index).collect()] == ["Nope"]


def test_sink(spark, tmp_path):
    rows = spark.createDataFrame([("a\nb",), ("  \n",), (None,), ("c",)], "output string").coalesce(1)
    D.write_corpus(rows, f"{tmp_path}/out", records=1)
    assert len(list(tmp_path.glob("out/part-*"))) == 2
    assert spark.read.text(f"{tmp_path}/out").count() == 3


def test_native_equals_scanner(spark):
    texts = ["a  b\n\n\n\nc", "|x\n* \nCategory:Z\n__TOC__ y ()", "", "plain", "{{x\ny}} z", "reflist\nDEFAULTSORT:q"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert all(r["a"] == r["b"] for r in df.select(C.cleaned_flat("t").alias("a"), U.cleaned(df["t"]).alias("b")).collect())


def test_filters_stay_below_scanners(spark, dump):
    plan = A.parsed(A.main_pages(D.pages(spark, f"{dump}/d.xml")))._jdf.queryExecution().executedPlan().toString()
    lines = [x for x in plan.splitlines() if "Python" in x or "ArrowEval" in x or "Filter" in x]
    assert lines and "Filter" in lines[-1]


def test_nulls_and_empty(spark):
    df = spark.createDataFrame([("T", None), ("U", ""), (None, "x")], "title string, text string")
    assert A.rendered(df, Options(mode="metadata")).count() == 2
    assert A.parsed(df.limit(0)).count() == 0
    assert A.main_pages(df).count() == 0


def test_cyclic_graph(spark):
    edges = spark.createDataFrame([("A", "B"), ("B", "A"), ("B", "C")], "parent string, child string")
    members = spark.createDataFrame([("A", "1"), ("B", "1"), ("B", "2"), ("C", "3")], "category string, page string")
    root = spark.createDataFrame([("A",)], "name string")
    assert {r["page"] for r in R.pages_within(edges, members, root, 5).collect()} == {"1", "2", "3"}
    assert {r["page"] for r in R.pages_within(edges, members, root, 0).collect()} == {"1"}
    assert [tuple(r) for r in R.preview(edges, members, root, 1).collect()] == [("A", 2, 1, 3, 2)]
    assert {tuple(r["path"]) for r in R.category_tree(edges, root, 4).collect()} == {("A",), ("A", "B"), ("A", "B", "C")}


def test_stream(spark, tmp_path):
    folder = f"{tmp_path}/in"
    for k in range(3):
        spark.createDataFrame([(f"t{k}", "== A ==\nx [[Category:C]]"), (f"Talk:t{k}", "== B =="), (f"r{k}", "#REDIRECT [[x]]")], "title string, text string").write.mode("append").parquet(folder)
    pages = arriving.arriving_pages(spark, folder)
    q = arriving.running_section_counts(pages).writeStream.outputMode("complete").format("memory").queryName("counts").start()
    p = arriving.arriving_categories(pages).writeStream.outputMode("append").format("memory").queryName("cats").start()
    for x in (q, p):
        x.processAllAvailable()
        x.stop()
    assert [tuple(r) for r in spark.sql("SELECT * FROM counts").collect()] == [("A", 3)]
    assert spark.sql("SELECT * FROM cats").count() == 3


def test_sql_functions(spark):
    U.register(spark)
    assert spark.sql("SELECT wiki_plain('[[a|b]] {{convert|5|km|mi}}') AS x").first()["x"] == "b 5 km (3.1 mi)"
    assert spark.sql("SELECT e.type FROM VALUES ('== A ==\nx') t(x), LATERAL parse_wikitext(t.x) e").count() == 2
