"""Work that grows with the tables: texts are scanned once, in many tasks, in small slices and with few steps for each."""

import random
import sys

import pyarrow as pa
import pytest

from textloom.functions import article, scan
from textloom.functions import udfs as U
from textloom.functions.article import Options
from textloom.plans import queries as Q

SF = "/root/testdata/sf0.001"


def executed(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["section_window", "element_type_counts", "top_sections", "section_stats"])
def test_texts_are_parsed_once(spark, name):
    """explode() asks for lists that aren't empty; that isn't filtered by another parse, below the exchange."""
    assert executed(Q.QUERIES[name](spark, SF)).count("ArrowEvalPython") == 1


@pytest.mark.parametrize(("name", "key"), [("sections", "o_orderkey"), ("sections_alias_file", "o_orderkey"), ("summary", "c_custkey")])
def test_many_files_are_spread_before_texts_are_made(spark, tmp_path, monkeypatch, name, key):
    """Files say nothing of the tasks that read them: narrow rows are exchanged, over more tasks as the files grow."""
    for t in ("orders", "customer"):
        Q.table(spark, SF, t).repartition(8).write.parquet(f"{tmp_path}/{t}.parquet")
    for t in ("nation", "region"):
        Q.table(spark, SF, t).write.parquet(f"{tmp_path}/{t}.parquet")
    plan = executed(Q.QUERIES[name](spark, str(tmp_path)))
    assert f"hashpartitioning({key}" in plan
    assert plan.index("ArrowEvalPython [one(concat(") < plan.index("Exchange") and "concat(" not in plan[plan.index("Exchange") :]
    monkeypatch.setattr(Q, "TASK_BYTES", 1000)
    assert Q.QUERIES[name](spark, str(tmp_path)).rdd.getNumPartitions() > 4


def steps(f, *args):
    """Calls of functions, Python's and C's, that f makes."""
    n = 0

    def count(frame, event, arg):
        nonlocal n
        n += event in ("call", "c_call")

    sys.setprofile(count)
    try:
        f(*args)
    finally:
        sys.setprofile(None)
    return n


def test_a_table_is_marked_in_few_steps():
    text = "a{|\n|17{|\n|x\n|}\n|}N"
    assert scan.marks_shown(scan.mark(text, scan.MARKERS)) == "a[TABLE]N"
    assert steps(lambda: scan.marks_shown(scan.mark(text, scan.MARKERS))) < 60


def test_covered_is_nested():
    pick = random.Random(1)
    for _ in range(3000):
        text = "".join(pick.choice(["{|", "|}", "{", "|", "}", "a", "\n"]) for _ in range(pick.randint(0, 14)))
        assert scan.covered(text, "{|", "|}", "«x»") == scan.nested(text, "{|", "|}", lambda _: "«x»"), text


def test_sections_of_a_page_in_few_steps():
    text, o = "Lead\n== Childhood ==\nBorn\n=== Deep ===\nMore\n== Career ==\nWork\n== Notes ==\nn", Options(sections=("summary", "Career", "references"))
    run = lambda: {k: scan.cleaned(article.plain(v, o)) for k, v in article.sections(article.parse(text), o)[0].items()}
    assert run() == {"summary": "Lead\n\n", "Career": "Work\n\n", "references": "n\n\n"}
    assert steps(run) < 400


def test_tame_texts_are_those_without_a_step():
    def full(text):
        for pattern, by in scan._STEPS:
            text = pattern.sub(by, text)
        return text.strip() + "\n\n"

    pick = random.Random(2)
    parts = ["a", " ", "  ", "\t", "\n", "\n \n", "br", "Clear", "GND", "commons", "Wikimedia", "Commons", "cat", "notelist2", "DEFAULTSORT", "school", "(", ")", "|", "*", ":", "=", "x1"]
    for _ in range(3000):
        text = "".join(pick.choice(parts) for _ in range(pick.randint(0, 7)))
        assert scan.cleaned(text) == full(text), text


def test_targets_by_name_before_alias():
    o = Options(sections=("Early life", "Childhood", "notes", "CAREER", ""))
    assert [article.wanted(h, o) for h in ("childhood", "Early years", "References", "Notes ", "career", "professional career", "", "x")] == ["Childhood", "Early life", "notes", "notes", "CAREER", "CAREER", None, None]


@pytest.mark.parametrize("columns", [1, 2])
def test_batches_are_scanned_by_slices(monkeypatch, columns):
    """What is decoded and put out at a time is bounded by bytes, not by a batch's rows."""
    made = []
    monkeypatch.setattr(U, "arrow_udf", lambda f, kind: made.append(f) or (lambda *c: None))
    U.scanner(lambda *x: x[0].replace("&", "and"))(*range(columns))
    texts = [None if i % 7 == 0 else f"{i}&" + "x" * 4000 for i in range(2000)]
    batch = [pa.array(texts)] * columns
    out = list(made[0](iter([batch[0] if columns == 1 else tuple(batch), pa.array([], pa.string()) if columns == 1 else (pa.array([], pa.string()),) * 2])))
    assert max(a.nbytes for a in out) < 1 << 21
    assert [x for a in out for x in a.to_pylist()] == [None if t is None else t.replace("&", "and") for t in texts]


def test_slices_through_spark(spark):
    rows = spark.range(700).selectExpr("id", "CASE WHEN id % 5 <> 0 THEN concat(id, '&amp;', repeat('y', 9000)) END AS t").coalesce(1)
    got = rows.select("id", U.entities(rows["t"]).alias("r")).collect()
    assert all(r["r"] == (None if r["id"] % 5 == 0 else f"{r['id']}&" + "y" * 9000) for r in got) and len(got) == 700


def test_element_lists():
    assert U.element_lists([]).to_pylist() == []
    assert U.element_lists([None, [], [("a", "t", None), ("b", "u", 2)], None]).to_pylist() == [
        None, [], [{"pos": 0, "type": "a", "text": "t", "level": None}, {"pos": 1, "type": "b", "text": "u", "level": 2}], None
    ]
