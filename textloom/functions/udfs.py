"""The scanners as Arrow-batched functions of columns, and their registration for SQL."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf, udtf

from textloom.functions import article, scan, templates

ELEMENTS = "array<struct<pos:int,type:string,text:string,level:int>>"
_ELEMENT = pa.list_(pa.struct([("pos", pa.int32()), ("type", pa.string()), ("text", pa.string()), ("level", pa.int32())]))


#: Bytes of input that are decoded, scanned and put out at a time.
SLICE = 1 << 20


def sliced(columns: tuple[pa.Array, ...]) -> Iterator[tuple[pa.Array, ...]]:
    """A batch by slices of about SLICE bytes, so that memory is bounded by these, whatever rows a batch has."""
    rows = len(columns[0])
    step = max(1, rows * SLICE // max(1, sum(c.nbytes for c in columns)))
    for at in range(0, rows, step):
        yield tuple(c.slice(at, step) for c in columns)


def scanner(f: Callable, kind: str = "string", made: Callable[[list], pa.Array] | None = None, once: bool = False) -> Callable[..., Column]:
    """A column function of f, which sees one text, or several, at a time; null in, null out. `made` makes an array of
    results. With `once`, filters on the result stay above it: the optimizer would evaluate it again for a filter
    pushed below a projection."""
    made = made or partial(pa.array, type=pa.string())

    def many(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for batch in batches:
            for columns in sliced(batch) if len(batch[0]) else [batch]:
                yield made([None if row[0] is None else f(*row) for row in zip(*(c.to_pylist() for c in columns), strict=True)])

    def one(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            for (column,) in sliced((batch,)) if len(batch) else [(batch,)]:
                yield made([None if x is None else f(x) for x in column.to_pylist()])

    def column(*c: Column) -> Column:
        function = arrow_udf(one if len(c) == 1 else many, kind)
        return (function.asNondeterministic() if once else function)(*c)

    return column


def element_lists(articles: list[list[tuple[str, str, int | None]] | None]) -> pa.Array:
    """The elements of article.parse as an array of ELEMENTS, column by column."""
    rows = [e for a in articles for e in a or ()]
    ends = list(accumulate((len(a or ()) for a in articles), initial=0))
    kinds, texts, levels = zip(*rows, strict=True) if rows else ((), (), ())
    at = pa.array([i for a in articles for i in range(len(a or ()))], pa.int32())
    fields = [at, pa.array(kinds, pa.string()), pa.array(texts, pa.string()), pa.array(levels, pa.int32())]
    empty = pa.array([a is None for a in articles], pa.bool_())
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(fields, fields=list(_ELEMENT.value_type)), type=_ELEMENT, mask=empty)


entities = scanner(scan.entities)
without_html = scanner(scan.without_html)
links = scanner(scan.links)
external_links = scanner(scan.external_links)
without_templates = scanner(scan.without_templates)
without_tables = scanner(scan.without_tables)
without_complex = scanner(scan.without_complex)
inline_templates = scanner(scan.inline_templates)
cleaned = scanner(scan.cleaned)
expand = scanner(templates.expand_templates)
evaluate = scanner(templates.evaluate)
magic = scanner(lambda text, title: templates.magic(text, title or ""))
citation = scanner(scan.citation)
#: Evaluated once: what explode() asks of its lists would else be filtered below the exchange that spreads the texts, by a parse of its own.
elements = scanner(article.parse, ELEMENTS, element_lists, once=True)
prepared = scanner(article.prepared)
template_content = scanner(lambda c: scan._content(scan._split(c)))


def marked(text: Column, markers=None) -> Column:
    on = scan.chosen(markers)
    return scanner(lambda t: scan.marks_shown(scan.mark(t, on)))(text)


def plain(text: Column, options: article.Options = article.Options()) -> Column:  # noqa: B008
    return scanner(lambda t: article.plain(t, options))(text)


def rendered(title: Column, text: Column, options: article.Options = article.Options()) -> Column:  # noqa: B008
    return scanner(lambda t, x: article.render(t, x or "", options), once=True)(title, text)


def sections(text: Column, options: article.Options) -> Column:
    """map<target, text or null>."""
    def f(t: str) -> list[tuple[str, str | None]]:
        found, _ = article.sections(article.parse(t), options)
        return [(k, None if v is None else scan.cleaned(article.plain(v, options))) for k, v in found.items()]

    return scanner(f, "map<string,string>", partial(pa.array, type=pa.map_(pa.string(), pa.string())))(text)


@udtf(returnType="pos: int, type: string, text: string, level: int")
class ParseWikitext:
    """SELECT ... FROM t, LATERAL parse_wikitext(t.text)"""

    def eval(self, text: str):
        if text is not None:
            for pos, (kind, shown, level) in enumerate(article.parse(text)):
                yield pos, kind, shown, level


def register(spark: SparkSession) -> None:
    """Makes the scanners callable in SQL."""
    kinds = {"wiki_expand": templates.expand_templates, "wiki_evaluate": templates.evaluate, "wiki_links": scan.links, "wiki_clean": scan.cleaned, "wiki_plain": article.plain, "wiki_entities": scan.entities}
    for name, f in kinds.items():
        spark.udf.register(name, F.udf(lambda x, f=f: None if x is None else f(x), "string", useArrow=True))
    spark.udtf.register("parse_wikitext", ParseWikitext)
