"""Pages to articles: elements, headings, summaries, sections, statistics and output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions import columns as C
from textloom.functions import udfs as U
from textloom.functions.article import Options


def main_pages(pages: DataFrame, keep_redirects: bool = False) -> DataFrame:
    """(title, text) of articles: no other namespace, no redirect, no empty text. All native, so that it is
    filtered below any scanner."""
    rows = pages.where(C.main_namespace("title") & F.col("text").isNotNull() & (F.col("text") != ""))
    return rows if keep_redirects else rows.where(~C.is_redirect("text"))


def parsed(pages: DataFrame) -> DataFrame:
    """pages with `elements`; categories come natively from the text."""
    return pages.withColumn("elements", U.elements(F.col("text"))).withColumn("categories", C.categories("text"))


def exploded(articles: DataFrame, *keys: str) -> DataFrame:
    return articles.select(*keys, F.explode("elements").alias("e")).select(*keys, "e.pos", "e.type", "e.text", "e.level")


def headings(elements: Column | str = "elements") -> Column:
    """array<struct<name, level>> of the headings that have a name."""
    only = F.filter(elements, lambda e: e["type"] == "mw_heading")
    named = F.transform(only, lambda e: F.struct(C.heading_text(e["text"]).alias("name"), F.coalesce(e["level"], F.lit(2)).alias("level")))
    return F.filter(named, lambda h: h["name"] != "")


def summary(elements: Column | str = "elements") -> Column:
    """Content before the first heading; null if there is none."""
    elements = F.col(elements) if isinstance(elements, str) else elements
    at = F.array_position(F.transform(elements, lambda e: e["type"]), "mw_heading")
    head = F.when(at > 0, F.slice(elements, F.lit(1), (at - 1).cast("int"))).otherwise(elements)
    text = F.array_join(F.transform(F.filter(head, lambda e: ~e["type"].isin("mw_blank", "mw_redirect")), lambda e: e["text"]), "")
    return F.nullif(C.replaced(text, r"\A\s+|\s+\z"), F.lit(""))


def section_rows(elements: DataFrame, *keys: str) -> DataFrame:
    """Long form: every content element with the heading that it stands under, as a running window."""
    order = Window.partitionBy(*keys).orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    name = F.when(F.col("type") == "mw_heading", C.heading_text("text"))
    return elements.withColumn("section", F.last(name, ignorenulls=True).over(order)).where("type <> 'mw_heading'")


def section_counts(articles: DataFrame) -> DataFrame:
    """(name, count) over all articles: partial counts in the tasks, one exchange of names."""
    return articles.select(F.explode(headings()).alias("h")).groupBy(F.col("h.name").alias("name")).agg(F.count("*").alias("count"))


def top_sections(articles: DataFrame, n: int = 50) -> DataFrame:
    return section_counts(articles).orderBy(F.desc("count"), "name").limit(n)


def merged_counts(*parts: DataFrame) -> DataFrame:
    """Counts of several runs as one."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("name").agg(F.sum("count").alias("count"))


def section_report(articles: DataFrame, n: int = 50) -> DataFrame:
    """One row: total_articles, and the top sections as JSON."""
    top = top_sections(articles, n).agg(F.array_sort(F.collect_list(F.struct((-F.col("count")).alias("o"), "name", "count"))).alias("t"))
    report = top.select(F.to_json(F.transform("t", lambda x: F.struct(x["name"].alias("name"), x["count"].alias("count")))).alias("top_sections"))
    return articles.agg(F.count("*").alias("total_articles")).crossJoin(report)


def rendered(pages: DataFrame, options: Options = Options()) -> DataFrame:  # noqa: B008
    """(title, output) in the mode and format of the options; skipped articles are left out."""
    return pages.select("title", U.rendered(F.col("title"), F.col("text"), options).alias("output")).where("output is not null")


def metadata(articles: DataFrame) -> DataFrame:
    """title, section names and categories, as JSON and as tab-separated line; native."""
    names = F.transform(headings(), lambda h: h["name"])
    record = F.to_json(F.struct("title", names.alias("sections"), "categories"))
    line = F.concat_ws("\t", "title", F.array_join(names, "|"), F.array_join("categories", ","))
    return articles.select("title", record.alias("json"), line.alias("tsv"))


def page_stats(pages: DataFrame) -> DataFrame:
    """What a scan saw: pages, redirects and bytes."""
    return pages.agg(F.count("*").alias("pages"), F.count_if(C.is_redirect("text")).alias("redirects"), F.sum(F.octet_length("text")).alias("bytes"))
