"""The relational layer: title lookups, stream ranges, category graph and caches."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.columns import category_name, fresh
from textloom.sources.scratch import written


def by_titles(index: DataFrame, titles: DataFrame) -> DataFrame:
    """Index entries of the titles asked for. Spark broadcasts the smaller side if its size allows."""
    return index.join(titles.select("title").distinct(), "title", "left_semi")


def by_ids(index: DataFrame, ids: DataFrame) -> DataFrame:
    return index.join(ids.select("page_id").distinct(), "page_id", "left_semi")


def missing_titles(titles: DataFrame, index: DataFrame) -> DataFrame:
    return titles.join(index.select("title"), "title", "left_anti")


def last_entries(index: DataFrame, order: str) -> DataFrame:
    """Of entries with one title, that of the largest `order`."""
    rest = [c for c in index.columns if c != "title"]
    return index.groupBy("title").agg(F.max_by(F.struct(*rest), order).alias("e")).select("title", "e.*")


def streams_needed(index: DataFrame, titles: DataFrame) -> DataFrame:
    return by_titles(index, titles).select("offset").distinct()


def stream_ranges(index: DataFrame) -> DataFrame:
    """(offset, next_offset): where each stream begins and ends; the last has no end. One row a stream, a hundredth
    of the pages, so its window in one task holds 8 bytes for each."""
    order = Window.partitionBy(F.lit(0)).orderBy("offset")
    return index.select("offset").distinct().withColumn("next_offset", F.lead("offset").over(order))


def streams_through(index: DataFrame, titles: DataFrame) -> DataFrame:
    """(offset, next_offset) of the streams from the first to the last that holds a title asked for: the part of a
    dump that has to be there. No title found: no stream."""
    last = streams_needed(index, titles).agg(F.max("offset").alias("last"))
    return stream_ranges(index).join(F.broadcast(last), F.col("offset") <= F.col("last")).drop("last")


def first_streams(index: DataFrame, n: int) -> DataFrame:
    """Entries of the first n streams: their offsets by top-n, then a semi join."""
    return index.join(index.select("offset").distinct().orderBy("offset").limit(n), "offset", "left_semi")


def first_articles(index: DataFrame, n: int) -> DataFrame:
    return index.orderBy("offset", "page_id").limit(n)


def random_articles(index: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """n entries in an order shuffled by hash, the same each time."""
    return index.orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), "title")), "title").limit(n)


# category graph


def reachable(edges: DataFrame, roots: DataFrame, depth: int) -> DataFrame:
    """(root, name, depth): categories within `depth` steps of each root, by the shortest way; cycles end there.

    Breadth first: every round joins the newest categories with the edges, and drops the ones known. Rounds are
    written, so that each has a plan of two joins, and the walk ends when there is nothing new."""
    found = written(roots.select(F.col("name").alias("root"), "name", F.lit(0).alias("depth")).distinct())
    new = found
    for step in range(1, depth + 1):
        there = new.join(edges, new["name"] == edges["parent"]).select("root", F.col("child").alias("name")).distinct()
        new = written(there.join(found.select("root", "name"), ["root", "name"], "left_anti").withColumn("depth", F.lit(step)))
        if new.isEmpty():
            break
        found = found.unionByName(new)
    return found


def pages_within(edges: DataFrame, members: DataFrame, roots: DataFrame, depth: int) -> DataFrame:
    """Distinct (root, page) of all categories within `depth` steps; members is (category, page)."""
    return _pages_of(reachable(edges, roots, depth), members)


def _pages_of(tree: DataFrame, members: DataFrame) -> DataFrame:
    return tree.join(members, F.col("name") == F.col("category")).select("root", "page").distinct()


def preview(edges: DataFrame, members: DataFrame, roots: DataFrame, depth: int) -> DataFrame:
    """(root, categories, subcategories, total_articles, distinct_articles): totals count a page once for each
    category, as a dry run does."""
    per = members.groupBy("category").agg(F.count("*").alias("n"))
    tree = reachable(edges, roots, depth)
    counts = tree.join(per, F.col("name") == F.col("category"), "left").groupBy("root").agg(
        F.count("*").alias("categories"), (F.count("*") - 1).alias("subcategories"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("total_articles")
    )
    distinct = _pages_of(tree, members).groupBy("root").agg(F.count("*").alias("distinct_articles"))
    return counts.join(distinct, "root", "left").withColumn("distinct_articles", F.coalesce("distinct_articles", F.lit(0)))


def category_tree(edges: DataFrame, roots: DataFrame, depth: int) -> DataFrame:
    """(root, path, name, depth): every way from a root that meets no category twice."""
    rows = roots.select(F.col("name").alias("root"), F.array("name").alias("path"), "name", F.lit(0).alias("depth")).distinct()
    out = rows
    for step in range(1, depth + 1):
        rows = rows.join(edges, rows["name"] == edges["parent"]).where(~F.array_contains("path", F.col("child"))).select("root", F.array_append("path", F.col("child")).alias("path"), F.col("child").alias("name"), F.lit(step).alias("depth"))
        out = out.unionByName(rows)
    return out


def counted_tree(edges: DataFrame, members: DataFrame, roots: DataFrame, depth: int) -> DataFrame:
    """(root, name, parent, depth, page_count, cached): the categories within `depth` steps, each below the least of
    the nearest parents, with its number of pages; cached, whether anything is known of it."""
    tree = reachable(edges, roots, depth)
    above = tree.select("root", F.col("name").alias("parent"), (F.col("depth") + 1).alias("depth"))
    up = tree.join(edges, tree["name"] == edges["child"]).join(above, ["root", "parent", "depth"]).groupBy("root", "name").agg(F.min("parent").alias("parent"))
    pages = members.groupBy(F.col("category").alias("name")).agg(F.count("*").alias("page_count"))
    known = pages.select("name").union(edges.select("parent")).distinct().withColumn("cached", F.lit(True))
    out = tree.join(up, ["root", "name"], "left").join(pages, "name", "left").join(known, "name", "left")
    return out.select("root", "name", "parent", "depth", F.coalesce("page_count", F.lit(0)).cast("long").alias("page_count"), F.coalesce("cached", F.lit(False)).alias("cached"))


# caches


def cached(cache: DataFrame, edges: DataFrame, members: DataFrame, names: DataFrame, now, days: int) -> DataFrame:
    """(name, pages, subcats) of the names that are cached and fresh; names come with or without their namespace."""
    wanted = names.select(category_name("name").alias("name")).distinct()
    there = cache.where(fresh(F.col("cached_at"), F.lit(now).cast("timestamp"), days)).join(wanted, "name", "left_semi").select("name")
    pages = members.groupBy(F.col("category").alias("name")).agg(F.sort_array(F.collect_list("page")).alias("pages"))
    below = edges.groupBy(F.col("parent").alias("name")).agg(F.sort_array(F.collect_list("child")).alias("subcats"))
    none = F.array().cast("array<string>")
    return there.join(pages, "name", "left").join(below, "name", "left").select("name", F.coalesce("pages", none).alias("pages"), F.coalesce("subcats", none).alias("subcats"))


def upserted(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """All rows of new, and of old those whose key new doesn't have."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def expired(cache: DataFrame, now, days: int) -> DataFrame:
    return cache.where(F.col("cached_at") < F.lit(now).cast("timestamp") - F.expr(f"interval {days} days"))


def without_expired(cache: DataFrame, edges: DataFrame, now, days: int, key: str = "name", edge_key: str = "category") -> tuple[DataFrame, DataFrame]:
    """Cache and edges without the categories that are too old."""
    gone = expired(cache, now, days).select(F.col(key).alias("gone"))
    return cache.join(gone, F.col(key) == F.col("gone"), "left_anti"), edges.join(gone, F.col(edge_key) == F.col("gone"), "left_anti")


def expired_count(cache: DataFrame, now, days: int) -> DataFrame:
    """One row: how many categories without_expired() removes."""
    return expired(cache, now, days).agg(F.count("*").alias("removed"))


def cache_stats(cache: DataFrame, *by: str) -> DataFrame:
    """Number of entries, and the oldest and newest; of each group, where columns are named."""
    return cache.groupBy(*by).agg(F.count("*").alias("entries"), F.min("cached_at").alias("oldest"), F.max("cached_at").alias("newest"))


def size_buckets(rows: DataFrame, text: str, order: str, limit: int, *group: str) -> DataFrame:
    """rows with `bucket`: the output file of each record, begun anew whenever the bytes before reach a multiple of
    `limit`, inside each group. Groups are filled in parallel."""
    before = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    so_far = F.coalesce(F.sum(F.octet_length(text)).over(before), F.lit(0))
    return rows.withColumn("bucket", F.floor(so_far / limit).cast("long") + 1)
