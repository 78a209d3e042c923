"""Main text of web pages by differencing each page with the page of the nearest URL on its host.

Pages of a host are ordered by URL path. A page's pair is the page before or after it, whichever shares the
longer beginning of the path; lines that both have, by longest common subsequence, are the host's template and go.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from math import isqrt
from os.path import commonprefix

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm._tables import partitions, written

_BLOCK = (
    "address|article|aside|blockquote|body|br|button|caption|center|dd|details|dialog|dir|div|dl|dt|fieldset|figcaption|figure|footer|form|"
    "frameset|h[1-6]|header|hgroup|hr|html|legend|li|main|menu|nav|ol|optgroup|option|p|pre|section|select|summary|table|tbody|td|textarea|tfoot|th|"
    "thead|tr|ul"
)
_GONE = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(script|style|noscript|template|head|svg)\b[^>]*>.*?(?:</\1\s*>|\Z)", re.I | re.S)
_BREAK = re.compile(rf"</?(?:{_BLOCK})\b[^>]*>", re.I)
_TAG = re.compile(r"<[/!?a-z][^>]*>", re.I)
_SPACE = re.compile(r"[ \t\r\f\v ]+")
_HOST = r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?"
_THIN = ["k1", "k2", "page_id", "host", "path", "lines"]


def lines_of(page: str | None) -> list[str]:
    """The visible lines of a page: scripts, styles, head and comments go, block elements end lines, entities are
    decoded, white space is folded, and empty lines are left out."""
    if not page:
        return []
    flat = _GONE.sub(lambda m: " " if m[0][:2] == "<!" else "\n", page)
    flat = _SPACE.sub(" ", html.unescape(_TAG.sub("", _BREAK.sub("\n", flat.replace("\n", " ")))))
    return [x for x in (line.strip() for line in flat.split("\n")) if x]


def common(a: list, b: list) -> list[int]:
    """Positions in a of a longest common subsequence of a and b; of several, the one found from the ends backwards
    that leaves a's last element if it can, else b's."""
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    x, y = a[head : len(a) - tail], b[head : len(b) - tail]
    known = set(x) & set(y)
    at = [i for i, v in enumerate(x) if v in known]
    middle = _aligned([x[i] for i in at], [v for v in y if v in known])
    return [*range(head), *(head + at[i] for i in middle), *range(len(a) - tail, len(a))]


class _Rows:
    """Bit vectors after each element of x: a zero at bit j says that the common length grows at y[j]. Those between
    two marks are made again when they are asked for, from the end backwards, so that two stretches are held."""

    LEAST = 512

    def __init__(self, x: list, y: list):
        self.x, self.full, self.size = x, (1 << len(y)) - 1, max(self.LEAST, isqrt(len(x)))
        self.where: dict = {}
        for j, v in enumerate(y):
            self.where[v] = self.where.get(v, 0) | 1 << j
        self.marks, self.held, v = [], {}, self.full
        for a in range(0, len(x), self.size):
            self.marks.append(v)
            self.held = {a // self.size: self._stretch(a, v)}
            v = self.held[a // self.size][-1]

    def _stretch(self, a: int, v: int) -> list[int]:
        out = []
        for e in self.x[a : a + self.size]:
            u = v & self.where.get(e, 0)
            v = ((v + u) | (v - u)) & self.full
            out.append(v)
        return out

    def __getitem__(self, i: int) -> int:
        k = i // self.size
        if k not in self.held:
            self.held = {k: self._stretch(k * self.size, self.marks[k])} | {j: r for j, r in self.held.items() if j == k + 1}
        return self.held[k][i % self.size]


def _aligned(x: list, y: list) -> list[int]:
    if not x or not y:
        return []
    rows = _Rows(x, y)
    i, j, out = len(x) - 1, len(y) - 1, []
    while i >= 0 and j >= 0:
        if i and not (rows[i] ^ rows[i - 1]) & ((1 << j + 1) - 1):
            i -= 1
            continue
        ones = (1 << j + 1) - 1
        here = (~rows[i] & ones).bit_count()
        if i and (~rows[i - 1] & ones).bit_count() == here:
            i -= 1
        elif not here:
            break
        elif (~rows[i] & (ones >> 1)).bit_count() == here:
            j -= 1
        else:
            out.append(i)
            i, j = i - 1, j - 1
    return out[::-1]


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lines = [[xxhash.xxh3_64_intdigest(x) - (1 << 63) for x in lines_of(p)] for p in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(c) for c in _THIN[:-1]] + [pa.array(lines, pa.list_(pa.int64()))], names=_THIN)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["page_id", "url", "k1", "k2"]
    for batch in batches:
        text = ["\n".join(lines_of(p)) for p in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(c) for c in names] + [pa.array(text, pa.string())], names=[*names, "lines"])


_ROW = ["k1", "k2", "page_id", "host", "path", "lines"]
_MET = "k1 long, k2 long, pair_id long, gone array<int>, part int, spot int, last boolean, page_id long, host string, path string, lines array<long>"


def _pair(row: dict, before: dict | None, after: dict | None) -> tuple[int, int, int | None, list[int]] | None:
    """What goes from a page: the lines that it has in common with the neighbour of its host whose path begins alike."""
    best, score = None, -1
    for side in (before, after):
        if side and side["host"] == row["host"] and side["lines"] != row["lines"] and (n := len(commonprefix([row["path"], side["path"]]))) > score:
            best, score = side, n
    return (row["k1"], row["k2"], best["page_id"], common(row["lines"], best["lines"])) if best else None


def _batch(found: list[tuple], ends: list[tuple[int, bool, dict]]) -> pa.RecordBatch:
    part = TaskContext.get().partitionId()
    rows = [(*f, None, None, None, None, None, None, None) for f in found]
    rows += [(r["k1"], r["k2"], None, None, part, spot, last, r["page_id"], r["host"], r["path"], r["lines"]) for spot, last, r in ends]
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.int32(), pa.int32(), pa.bool_(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int64()))
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[c.split(" ")[0] for c in _MET.split(", ")])


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages come in order. Those with a page on either side in the partition are done with; the first two and the last
    two go on, so that what lies on the next partition's border is found."""
    held: list[dict] = []  # the two before
    count = 0
    for batch in batches:
        found, ends = [], []
        for row in batch.select(_ROW).to_pylist():
            if len(held) == 2 and (out := _pair(held[1], held[0], row)):
                found.append(out)
            if count < 2:
                ends.append((count, False, row))
            held = [*held[-1:], row]
            count += 1
        if found or ends:
            yield _batch(found, ends)
    if held:
        yield _batch([], [(count - len(held) + i, i == len(held) - 1, r) for i, r in enumerate(held)])


def _borders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The ends of all partitions in order: the first and the last page of each are done with here."""
    rows: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if rows and (rows[-1]["part"], rows[-1]["spot"]) == (row["part"], row["spot"]):
                rows[-1]["last"] |= row["last"]
            else:
                rows.append(row)
    found = [out for i, r in enumerate(rows) if (r["spot"] == 0 or r["last"]) and (out := _pair(r, rows[i - 1] if i else None, rows[i + 1] if i + 1 < len(rows) else None))]
    if found:
        yield _batch(found, [])


def _rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        total, removed, text = [], [], []
        for lines, gone in zip(batch.column("lines").to_pylist(), batch.column("gone").to_pylist(), strict=True):
            each, out = lines.split("\n") if lines else [], set(gone or ())
            total.append(len(each))
            removed.append(len(out))
            text.append("\n".join(x for i, x in enumerate(each) if i not in out))
        columns = [batch.column(c) for c in ("page_id", "url", "pair_id")]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(total, pa.int32()), pa.array(removed, pa.int32()), pa.array(text, pa.string())], names=["page_id", "url", "pair_id", "n_lines", "n_removed", "text"])


def main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, pair_id, n_lines, n_removed, text) for every row of pages (page_id, url, html).

    pair_id is the page that the page was compared with; n_lines counts its visible lines; text holds those that
    aren't on the pair's page. The host is the URL's, in lower case; the path ends before ? and #. Both neighbours
    sharing equally much of the path, the one before is taken; pages of equal path come by page_id. A neighbour
    whose lines are all the same is a copy and tells nothing of the template: then the other one is taken. Where
    that is a copy too, or missing, there is no pair and all lines stay, even if the host has other pages.

    A null URL, or one without host, or a host with no second page: no pair, and all lines stay. Null and empty
    html: no lines, text ''. Very long pages are compared whole. Null page_id: the page takes part like others. Repeated rows count once in the
    order and each get the same result. No pages: no rows. Other columns are ignored, whatever their names.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    keyed = rows.select("*", F.xxhash64("page_id", "url", "html").alias("k1"), F.xxhash64("html", F.lit(1), "url", "page_id").alias("k2"))
    host = F.lower(F.regexp_extract("url", rf"{_HOST}([^/?#]+)", 1))
    path = F.regexp_extract("url", rf"{_HOST}[^/?#]+([^?#]*)", 1)
    # html is parsed once more below, but only hashes of lines are shuffled here
    thin = keyed.select("k1", "k2", "page_id", host.alias("host"), path.alias("path"), "html").where("host <> ''")
    thin = thin.mapInArrow(_hashed, "k1 long, k2 long, page_id long, host string, path string, lines array<long>").dropDuplicates(["host", "k1", "k2"])
    # pages are sorted by ranges, so that a host of any size is many tasks' work; two pages at each end of a range are
    # paired over the borders, in one task with four rows for each range
    order = ["host", "path", F.col("page_id").asc_nulls_first(), "k1", "k2"]
    laid = thin.repartitionByRange(partitions(pages.sparkSession), *order).sortWithinPartitions(*order)
    met = written(laid.mapInArrow(_met, _MET))
    borders = met.where("part is not null").repartition(1).sortWithinPartitions("part", "spot").mapInArrow(_borders, _MET)
    found = met.where("part is null").union(borders).select("k1", "k2", "pair_id", "gone")
    full = keyed.mapInArrow(_texts, "page_id long, url string, k1 long, k2 long, lines string").join(found, ["k1", "k2"], "left")
    return full.select("page_id", "url", "pair_id", "lines", "gone").mapInArrow(_rest, "page_id long, url string, pair_id long, n_lines int, n_removed int, text string")
