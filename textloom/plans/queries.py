"""Queries over the driver's tables, each with SQL that computes what is to come out from the source columns.

No table holds wikitext, so a query builds it from columns, applies an operator, and the SQL states the result
without the operator.
"""

from __future__ import annotations

import bz2
import datetime as dt
from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import columns as C
from textloom.functions import udfs as U
from textloom.functions.article import Options
from textloom.operators import articles as A
from textloom.operators import relations as R
from textloom.sources import dumps, index_cache, scratch, settings, sinks
from textloom.streaming import arriving

Query = Callable[[SparkSession, str], DataFrame]
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "conversations", "benchmark", "labels", "embeddings")
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
#: Newline in DuckDB.
NL = "chr(10)"
NATIONS = "nation JOIN region ON n_regionkey = r_regionkey"
CUSTOMERS = "customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"
NOW = dt.datetime(2024, 6, 15, 14, 30, 45)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sourced(spark: SparkSession, sf_dir: str, tables: str, *columns: str) -> DataFrame:
    words = [f"parquet.`{sf_dir}/{w}.parquet`" if w in TABLES else w for w in tables.split(" ")]
    return spark.sql(f"SELECT {', '.join(columns)} FROM {' '.join(words)}")


def case(name: str, tables: str, key: str, source: str, op: Callable[..., Column], expected: str, extra: str = "") -> None:
    """A query that applies op to a text built from columns, row by row."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = sourced(spark, sf_dir, tables, key, f"{source} AS src", *([f"{extra} AS more"] if extra else []))
        return rows.select(*key.split(", "), op(F.col("src"), *([F.col("more")] if extra else [])).alias("result"))

    QUERIES[name] = run
    ORACLE_SQL[name] = f"SELECT {key}, {expected} AS result FROM {tables}"


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


Q3, Q2 = "repeat(chr(39), 3)", "repeat(chr(39), 2)"

# links, marks and HTML

case("interwiki_links", CUSTOMERS, "c_custkey", "concat('[[', n_name, '|', c_mktsegment, ']] of [[', c_name, ']]')", U.links, "c_mktsegment || ' of ' || c_name")
case("flat_links", CUSTOMERS, "c_custkey", "concat('[[', n_name, '|', c_mktsegment, ']] of [[', c_name, ']]')", C.flat_links, "c_mktsegment || ' of ' || c_name")
case("category_links", CUSTOMERS, "c_custkey", "concat('a[[Category:', n_name, ']]b[[Kategorie:', r_name, '|key]]c')", U.links, "'abc'")
case("file_captions", "part", "p_partkey", "concat('[[File:', p_name, '.jpg|thumb|', p_size, 'px|A [[', p_brand, '|', p_type, ']] part]]')", U.links, "'A ' || p_type || ' part'")
case("pipe_trick", CUSTOMERS, "c_custkey", "concat('[[Help:', c_name, ' (', n_name, ')|]] and [[', n_name, ', ', r_name, '|]]')", U.links, "c_name || ' and ' || n_name")
case("pipe_trick_native", CUSTOMERS, "c_custkey", "concat('Help:', c_name, ' (', n_name, ')')", C.pipe_trick, "c_name")
case("external_links", "pages", "page_id", "concat('[', url, ' page ', page_id, '] and [', url, ']')", U.external_links, "'page ' || page_id || ' and ' || url")
case("external_links_native", "pages", "page_id", "concat('[', url, ' page ', page_id, '] and [', url, ']')", C.flat_external_links, "'page ' || page_id || ' and ' || url")
case("nested_links", "part", "p_partkey", "concat('[[a|', '[[b|[[', p_brand, ']]]]', ' x]]')", U.links, "p_brand || ' x'")
case("emphasis_strip", "part", "p_partkey", f"concat({Q3}, p_name, {Q3}, ' and ', {Q2}, p_brand, {Q2})", C.without_emphasis, "p_name || ' and ' || p_brand")
case("emphasis_documents", "documents", "doc_id", f"concat({Q3}, 'x', {Q3}, text)", C.without_emphasis, "'x' || text")
case("hr_strip", "part", "p_partkey", "concat(p_name, '\\n----\\n', p_brand)", C.without_rules, f"p_name || {NL} || {NL} || p_brand")
case("tag_strip", "part", "p_partkey", "concat('<b class=\"x\">', p_name, '</b><br>', p_type)", C.without_tags, "p_name || p_type")
case("tag_strip_pages", "pages", "page_id", "html", C.without_tags, "regexp_replace(html, '<[^<>]*>', '', 'g')")
case("html_comments", "pages", "page_id", "html", C.without_comments, "regexp_replace(html, '(?s)<!--.*?-->', '', 'g')")
case("self_closing_tags", "pages", "page_id", "concat(html, '<br/><img src=x/>')", C.without_self_closed, "regexp_replace(html || '<br/><img src=x/>', '<[^<>]+/>', '', 'g')")
case("remove_html_blocks", "part", "p_partkey", "concat(p_name, '<div>a<div>b</div>c</div>', p_brand, '<gallery>g</gallery><!-- c -->', p_type)", U.without_html, "p_name || p_brand || p_type")
case("remove_inbetween", "part", "p_partkey", "concat(p_name, '<', p_brand, '>', p_type)", partial(C.between, left="<", right=">"), "p_name || p_type")
case("directives", "part", "p_partkey", "concat('__NOTOC__', p_name, '__FORCETOC__')", C.without_switches, "p_name")
case("dashes", "part", "p_partkey", "concat(p_name, '{ndash}', p_brand, '{mdash}', p_size)", C.dashes, "p_name || '–' || p_brand || '–' || p_size")
case("refs_marked", "supplier", "s_suppkey", "concat(s_name, '<ref name=\"a\">', s_nationkey, '</ref><ref name=\"a\"/><br/>x')", C.references, f"s_name || '[ref]' || s_nationkey || '[/ref]' || {NL} || 'x'")
case("refs_strip", "supplier", "s_suppkey", "concat(s_name, '[ref]', s_nationkey, '\\n x[/ref] y')", C.without_references, "s_name || ' y'")
case("entity_decode", "pages", "page_id", "html", U.entities, "replace(replace(replace(replace(html, '&copy;', '©'), '&middot;', '·'), '&quot;', '\"'), '&amp;', '&')")
case("entity_numeric", "part", "p_partkey", "concat('&#', 65 + p_size % 26, ';&#x', hex(97 + p_size % 26), ';&#1550315000;&ratio;')", U.entities, "chr(65 + p_size % 26) || chr(97 + p_size % 26) || '∶'")
case("valid_text", "documents", "doc_id", "text", C.valid_text, "text")
case("complex_removed", "part", "p_partkey", "concat(p_name, '{{Infobox\\n|a={{b|c}}\\n}}', p_brand, '{{efn|x}}', '<<', p_type, '>>')", U.without_complex, "p_name || p_brand || '《' || p_type || '》'")
case("list_marks", "part", "p_partkey", "concat('*# ', p_name)", C.list_text, "p_name")
case("unbalanced_links", "part", "p_partkey", "concat('[[', p_name, CASE WHEN p_size % 2 = 0 THEN ']]' ELSE '' END)", C.unbalanced_links, "p_size % 2 <> 0")
case("heading_level", "part", "p_partkey", "concat(repeat('=', p_size % 6), ' ', p_name)", C.heading_level, "CASE WHEN p_size % 6 = 0 THEN 2 ELSE p_size % 6 END")
case("heading_text", "part", "p_partkey", "concat('== ', p_name, ' ==')", C.heading_text, "p_name")

# markers, templates and tables

case("marker_math", "part", "p_partkey", "concat(p_name, '<math>', p_size, '</math>{{math|x}}')", U.marked, "p_name || '[MATH][MATH]'")
case("marker_code", "part", "p_partkey", "concat('<code>', p_name, '</code>', p_brand, '<pre>\\n', p_size, '</pre>')", U.marked, "'[CODE]' || p_brand || '[CODEBLOCK]'")
case("marker_tag_native", "part", "p_partkey", "concat('<score>', p_name, '</score>', p_brand)", partial(C.tag_marker, kind="score"), "'[SCORE]' || p_brand")
case("marker_table", "lineitem", "l_orderkey, l_linenumber", "concat('a{|\\n|', l_quantity, '{|\\n|x\\n|}\\n|}', l_returnflag)", U.marked, "'a[TABLE]' || l_returnflag")
case("marker_templates", "part", "p_partkey", "concat('{{Infobox x|a={{b|', p_name, '}}}}', p_brand, '{{Navbox|n}}{{reflist|2}}{{IPA|x}}')", U.marked, "'[INFOBOX]' || p_brand || '[NAVBOX][REFERENCES][IPA]'")
case("marker_off", "part", "p_partkey", "concat(p_brand, '<math>', p_name, '</math>{{Infobox|x}}<gallery>g</gallery>')", partial(U.marked, markers=False), "p_brand")
case("marker_chosen", "part", "p_partkey", "concat('<math>', p_name, '</math><code>c</code>', p_brand)", partial(U.marked, markers=("code",)), "'[CODE]' || p_brand")
case("marker_paired", "part", "p_partkey", "concat(p_name, '{{refbegin}}', p_type, '{{refend}}', p_brand)", U.marked, "p_name || '[REFERENCES]' || p_brand")
case("marker_chem", "part", "p_partkey", "concat(p_name, '<chem>H2O</chem>{{chem|H|2|O}}{{ce|x}}<timeline>t</timeline><graph>g</graph>')", U.marked, "p_name || '[CHEM][CHEM][CHEM][TIMELINE][GRAPH]'")
case("marker_sidebar", "part", "p_partkey", "concat(p_name, '{{Sidebar|x}}<gallery>g</gallery><mapframe>m</mapframe><imagemap>i</imagemap><references/>')", U.marked, "p_name || '[SIDEBAR][GALLERY][MAPFRAME][IMAGEMAP][REFERENCES]'")
case("nested_templates", "part", "p_partkey", "concat('{{a|{{b|{{c|', p_name, '}}}}}}', p_brand, '{x}')", U.without_templates, "p_brand")
case("tables_removed", "part", "p_partkey", "concat(p_name, '{| class=x\\n|-\\n| a {| b |} c\\n|}', p_brand)", U.without_tables, "p_name || p_brand")
case("citations", "supplier", "s_suppkey", "concat('cite web|last=', s_name, '|first=F|title=T ', s_suppkey, '|date=20', 10 + s_nationkey, '-01-02')", U.citation, "s_name || ', F. \"T ' || s_suppkey || '\". 20' || (10 + s_nationkey) || '.'")
case("citation_partial", "supplier", "s_suppkey", "concat('cite book|title=', s_name)", U.citation, "'\"' || s_name || '\".'")
case("inline_templates", "part", "p_partkey", "concat('{{lang|fr|', p_name, '}} {{nowrap|', p_brand, '}} {{convert|', p_size, '|km}} {{reflist}}{{USA}}{{ruby|', p_type, '|r}}')", U.inline_templates, "p_name || ' ' || p_brand || ' ' || p_size || ' km ' || p_type || '（r）'")
case("template_content", "part", "p_partkey", "concat('name|a=', p_brand, '|', p_name)", U.template_content, "p_name")
case("plain_text", CUSTOMERS, "c_custkey", f"concat({Q3}, c_name, {Q3}, ' is in [[', n_name, '|', r_name, ']]. {{{{convert|100|C|F}}}}')", U.plain, "c_name || ' is in ' || r_name || '. 100 °C (212 °F)'")

# template expander

Y, M, D = "year(o_orderdate)", "month(o_orderdate)", "day(o_orderdate)"
MDY, DMY = "strftime(o_orderdate, '%B %-d, %Y')", "strftime(o_orderdate, '%-d %B %Y')"


def _age(born: str, then: str) -> str:
    return f"(year({then}) - year({born}) - CASE WHEN strftime({then}, '%m%d') < strftime({born}, '%m%d') THEN 1 ELSE 0 END)"


AGE = _age("o_orderdate", "TIMESTAMP '2024-06-15'")
THEN = "(o_orderdate::DATE + (o_orderkey % 20000)::INT)"
LATER = "date_add(to_date(o_orderdate), cast(o_orderkey % 20000 as int))"
SIX = f"concat({Y}, '|', {M}, '|', {D}, '|', year({LATER}), '|', month({LATER}), '|', day({LATER}))"


def template(name: str, tables: str, key: str, source: str, expected: str) -> None:
    case(name, tables, key, source, U.expand, expected)


template("tmpl_birth_date", "orders", "o_orderkey", f"concat('{{{{birth date|', {Y}, '|', {M}, '|', {D}, '}}}}')", MDY)
template("tmpl_start_date_df", "orders", "o_orderkey", f"concat('{{{{start date|', {Y}, '|', {M}, '|', {D}, '|df=yes}}}}')", DMY)
template("tmpl_date_month", "orders", "o_orderkey", f"concat('{{{{date|', {Y}, '|', {M}, '}}}}')", "strftime(o_orderdate, '%B %Y')")
template("tmpl_birth_age", "orders", "o_orderkey", f"concat('{{{{birth date and age|', {Y}, '|', {M}, '|', {D}, '}}}}')", f"{MDY} || ' (age ' || {AGE} || ')'")
template("tmpl_age", "orders", "o_orderkey", f"concat('{{{{age|', {Y}, '|', {M}, '|', {D}, '}}}}')", f"CAST({AGE} AS VARCHAR)")
template("tmpl_death_age", "orders", "o_orderkey", f"concat('{{{{death date and age|', year({LATER}), '|', month({LATER}), '|', day({LATER}), '|', {Y}, '|', {M}, '|', {D}, '}}}}')", f"strftime({THEN}, '%B %-d, %Y') || ' (aged ' || {_age('o_orderdate', THEN)} || ')'")
template("tmpl_age_in_years", "orders", "o_orderkey", f"concat('{{{{age in years|', {SIX}, '}}}}')", f"CAST({_age('o_orderdate', THEN)} AS VARCHAR)")
template("tmpl_age_in_days", "orders", "o_orderkey", f"concat('{{{{age in days|', {SIX}, '}}}}')", "CAST(o_orderkey % 20000 AS VARCHAR)")
template(
    "tmpl_years_and_days", "orders", "o_orderkey", f"concat('{{{{age in years and days|', {SIX}, '}}}}')",
    f"{_age('o_orderdate', THEN)} || ' years, ' || date_diff('day', CASE WHEN strftime({THEN}, '%m%d') < strftime(o_orderdate, '%m%d') THEN make_date(year({THEN}) - 1, month(o_orderdate), 1) + (day(o_orderdate)::INT - 1) "
    f"ELSE make_date(year({THEN}), month(o_orderdate), 1) + (day(o_orderdate)::INT - 1) END::DATE, {THEN}) || ' days'",
)
template("tmpl_time_ago", "orders", "o_orderkey", f"concat('{{{{time ago|', {Y}, '|', {M}, '|', {D}, '}}}}')", "round(date_diff('day', o_orderdate::DATE, DATE '2024-06-15')::DECIMAL(18, 4) / 365)::INT || ' years ago'")
template("tmpl_convert", "part", "p_partkey", "concat('{{convert|', p_size, '|in|cm}}')", "p_size || ' in (' || regexp_replace(printf('%.1f', round((p_size * 254)::DECIMAL(18, 3) / 100, 1)), '\\.0$', '') || ' cm)'")
template("tmpl_convert_temperature", "part", "p_partkey", "concat('{{cvt|', p_size, '|C|F}}')", "p_size || ' °C (' || round((p_size * 18)::DECIMAL(18, 3) / 10 + 32)::INT || ' °F)'")
template("tmpl_convert_unknown", "part", "p_partkey", "concat('{{convert|', p_size, '|foo|bar}}')", "p_size || ' foo'")
template("tmpl_circa", "orders", "o_orderkey", f"concat('{{{{circa|', {Y}, '}}}}; {{{{c.|', {Y}, '|', {Y} + 5, '}}}}')", f"'c. ' || {Y} || '; c. ' || {Y} || ' – c. ' || ({Y} + 5)")
template("tmpl_floruit_reign", "orders", "o_orderkey", f"concat('{{{{fl.|', {Y}, '|', {Y} + 1, '}}}} {{{{reign|', {Y}, '|', {Y} + 2, '}}}} {{{{played years|', {Y}, '|', {Y} + 3, '}}}}')", f"'fl. ' || {Y} || '–' || ({Y} + 1) || ' r. ' || {Y} || '–' || ({Y} + 2) || ' ' || {Y} || '–' || ({Y} + 3)")
template("tmpl_marriage", CUSTOMERS, "c_custkey", "concat('{{marriage|', c_name, '|1990|2020|reason=', CASE WHEN c_custkey % 2 = 0 THEN 'widowed' ELSE 'x' END, '}}')", "c_name || ' (m. 1990; ' || CASE WHEN c_custkey % 2 = 0 THEN 'wid.' ELSE 'div.' END || ' 2020)'")
template("tmpl_coord", "part", "p_partkey", "concat('{{coord|', p_size, '|', p_size + 1, '}} {{coord|', p_size, '|n|', p_size, '|e}} {{coord|1|2|3|N|4|5|', p_size, '|W}}')", "p_size || '°, ' || (p_size + 1) || '° ' || p_size || '° N, ' || p_size || '° E 1°2′3″ N, 4°5′' || p_size || '″ W'")
template("tmpl_lang", NATIONS, "n_nationkey", "concat('{{lang|fr|', n_name, '|lit=', r_name, '}} {{lang-fr|', n_name, '}} {{lang-xyz|', n_name, '}}')", "n_name || ' (lit. ' || chr(39) || r_name || chr(39) || ') French: ' || n_name || ' XYZ: ' || n_name")
template("tmpl_nihongo", NATIONS, "n_nationkey", "concat('{{nihongo|', n_name, '|', r_name, '|r}} {{transl|ja|', r_name, '}}')", "n_name || ' (' || r_name || ', r) ' || r_name")
template("tmpl_formatting", "part", "p_partkey", "concat('{{nowrap|', p_name, '}}{{small|', p_brand, '}}{{abbr|', p_size, '|long}}{{sub|2}}')", "p_name || p_brand || p_size || '2'")
template("tmpl_quote", "part", "p_partkey", "concat('{{quote|', p_name, '|', p_brand, '}} {{blockquote|text=', p_type, '}}')", "p_name || ' — ' || p_brand || ' ' || p_type")
template("tmpl_fraction", "part", "p_partkey", "concat('{{frac|', p_size, '}} {{frac|1|', p_size, '}} {{sfrac|2|1|', p_size, '}}')", "'1/' || p_size || ' 1/' || p_size || ' 2+1/' || p_size")
template("tmpl_as_of", "orders", "o_orderkey", f"concat('{{{{as of|', {Y}, '|', {M}, '|', {D}, '}}}} {{{{as of|', {Y}, '}}}} {{{{sic}}}} {{{{wikt|a|b}}}}')", f"'As of ' || {MDY} || ' As of ' || {Y} || ' [sic] b'")
template("tmpl_nested", "part", "p_partkey", "concat('{{nowrap|{{small|', p_name, '}} {{frac|1|', p_size, '}}}}{{no such|x}}')", "p_name || ' 1/' || p_size")

# parser functions


def function(name: str, tables: str, key: str, source: str, expected: str) -> None:
    case(name, tables, key, source, U.evaluate, expected)


function("pf_if", "part", "p_partkey", "concat('{{#if:', CASE WHEN p_size > 25 THEN p_name ELSE ' ' END, '|', p_brand, '|none}}')", "CASE WHEN p_size > 25 THEN p_brand ELSE 'none' END")
function("pf_ifeq", "part", "p_partkey", "concat('{{#ifeq:', p_size, '|', p_size % 30, '.0|same|other}}{{#ifeq:', p_brand, '|Brand#11|y|n}}')", "CASE WHEN p_size = p_size % 30 THEN 'same' ELSE 'other' END || CASE WHEN p_brand = 'Brand#11' THEN 'y' ELSE 'n' END")
function("pf_switch", "orders", "o_orderkey", "concat('{{#switch:', o_orderstatus, '|F=done|O|P=open|#default=', o_orderpriority, '}}')", "CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'open' WHEN 'P' THEN 'open' ELSE o_orderpriority END")
function("pf_switch_default", "orders", "o_orderkey", "concat('{{#switch:', o_orderstatus, '|F=done|', o_orderpriority, '}}')", "CASE WHEN o_orderstatus = 'F' THEN 'done' ELSE o_orderpriority END")
function("pf_expr", "part", "p_partkey", "concat('{{#expr:(', p_size, ' + 3) * 2 - ', p_size, ' mod 7}}')", "CAST((p_size + 3) * 2 - p_size % 7 AS VARCHAR)")
function("pf_expr_logic", "part", "p_partkey", "concat('{{#expr:', p_size, ' > 20 and ', p_size, ' <= 40 or ', p_size, ' = 3}}')", "CASE WHEN p_size > 20 AND p_size <= 40 OR p_size = 3 THEN '1' ELSE '0' END")
function("pf_expr_quarter", "part", "p_partkey", "concat('{{#expr:', p_size, ' / 4}}')", "rtrim(rtrim(printf('%.2f', p_size / 4.0), '0'), '.')")
function("pf_ifexpr", "part", "p_partkey", "concat('{{#ifexpr:', p_size, ' < 10|small|large}}')", "CASE WHEN p_size < 10 THEN 'small' ELSE 'large' END")
function("pf_iferror", "part", "p_partkey", "concat('{{#iferror:', CASE WHEN p_size > 30 THEN 'Expression error' ELSE p_name END, '|bad|', p_brand, '}}')", "CASE WHEN p_size > 30 THEN 'bad' ELSE p_brand END")
function("pf_len", "part", "p_partkey", "concat('{{#len:', p_name, '}}')", "CAST(length(p_name) AS VARCHAR)")
function("pf_pos", "part", "p_partkey", "concat('{{#pos:', p_name, '|a}};{{#rpos:', p_name, '|a}}')", "CASE WHEN strpos(p_name, 'a') > 0 THEN CAST(strpos(p_name, 'a') - 1 AS VARCHAR) ELSE '' END || ';' || CASE WHEN strpos(p_name, 'a') > 0 THEN length(p_name) - strpos(reverse(p_name), 'a') ELSE -1 END")
function("pf_sub", "part", "p_partkey", "concat('{{#sub:', p_name, '|1|3}}')", "substr(p_name, 2, 3)")
function("pf_count", "part", "p_partkey", "concat('{{#count:', p_type, '|E}}')", "CAST(length(p_type) - length(replace(p_type, 'E', '')) AS VARCHAR)")
function("pf_replace", "part", "p_partkey", "concat('{{#replace:', p_type, '|E|_}}')", "replace(p_type, 'E', '_')")
function("pf_explode", "part", "p_partkey", "concat('{{#explode:', p_type, '|E|0}}')", "string_split(p_type, 'E')[1]")
function("pf_url", "part", "p_partkey", "concat('{{#urlencode:', p_type, ' &=}}', '{{#urldecode:a%20b+c}}')", "replace(p_type, ' ', '%20') || '%20%26%3D' || 'a b c'")
function("pf_pad", "part", "p_partkey", "concat('{{#padleft:', p_size, '|5|0}}{{#padright:', p_size, '|4}}|')", "lpad(p_size::VARCHAR, 5, '0') || rpad(p_size::VARCHAR, 4, ' ') || '|'")
function("pf_titleparts", "part", "p_partkey", "concat('{{#titleparts:', p_brand, '/', p_size, '/x|1|1}}')", "CAST(p_size AS VARCHAR)")
function("pf_time", "orders", "o_orderkey", "concat('{{#time:Y-m-d j F, D|', date_format(o_orderdate, 'yyyy-MM-dd'), '}}')", "strftime(o_orderdate, '%Y-%m-%d %-d %B, %a')")
# the outer function is evaluated first: its condition is the text of the inner one, which isn't blank
function("pf_nested", "part", "p_partkey", "concat('{{#if:{{#ifeq:', p_size, '|7|x}}|{{#expr:', p_size, '+1}}|no}}')", "CAST(p_size + 1 AS VARCHAR)")

# magic words

TITLE = "concat(p_brand, '/', p_size, '/', p_partkey)"


def word(name: str, tables: str, key: str, source: str, title: str, expected: str) -> None:
    case(name, tables, key, source, U.magic, expected, extra=title)


word("mw_pagename", "part", "p_partkey", "'{{PAGENAME}} {{FULLPAGENAME}} {{NAMESPACENUMBER}}{{TALKPAGENAME}}'", TITLE, "p_brand || '/' || p_size || '/' || p_partkey || ' ' || p_brand || '/' || p_size || '/' || p_partkey || ' 0Talk:' || p_brand || '/' || p_size || '/' || p_partkey")
word("mw_subpage", "part", "p_partkey", "'{{SUBPAGENAME}} {{ROOTPAGENAME}} {{BASEPAGENAME}}'", TITLE, "p_partkey || ' ' || p_brand || ' ' || p_brand || '/' || p_size")
word("mw_encoded", "part", "p_partkey", "concat('{{PAGENAMEE}} {{urlencode:', p_type, ' é}}')", "p_type", "replace(p_type, ' ', '_') || ' ' || replace(p_type, ' ', '_') || '_%C3%A9'")
word("mw_case", "part", "p_partkey", "concat('{{lc:', p_type, '}} {{uc:', p_name, '}} {{ucfirst:', lower(p_type), '}} {{lcfirst:', p_type, '}}')", "p_name", "lower(p_type) || ' ' || upper(p_name) || ' ' || upper(p_type[1]) || lower(p_type[2:]) || ' ' || lower(p_type[1]) || p_type[2:]")
word("mw_formatnum", "orders", "o_orderkey", "concat('{{formatnum:', o_orderkey * 1000, '.5}} {{formatnum:1,234|R}}')", "o_orderstatus", "format('{:,}', o_orderkey * 1000) || '.5 1234'")
word("mw_dates", "part", "p_partkey", "'{{CURRENTYEAR}}-{{CURRENTMONTH}}-{{CURRENTDAY2}} {{CURRENTDAYNAME}} {{LOCALTIMESTAMP}} {{CURRENTWEEK}}'", "p_name", "'2024-06-15 Saturday 20240615143045 24'")
word("mw_titleparts", "part", "p_partkey", f"concat('{{{{#titleparts:', {TITLE}, '|1|2}}}}')", "p_name", "CAST(p_size AS VARCHAR)")
word("mw_padding", "part", "p_partkey", "concat('{{padleft:', p_size, '|4}}{{padright:', p_size, '|4|x}}')", "p_name", "lpad(p_size::VARCHAR, 4, '0') || rpad(p_size::VARCHAR, 4, 'x')")
word("mw_grammar", "part", "p_partkey", "concat('{{plural:2|', p_name, '|', p_brand, '}}{{int:msg|x}}{{unknown}}')", "p_name", "p_name || 'msg{{unknown}}'")
case("names_native", "part", "p_partkey", TITLE, lambda t: F.concat_ws(";", C.base_name(t), C.root_name(t), C.sub_name(t), C.segments(t, 1, 2)), "p_brand || '/' || p_size || ';' || p_brand || ';' || p_partkey || ';' || p_size")
case("case_native", "part", "p_partkey", "p_type", lambda t: F.concat(C.first_lower(t), C.first_upper(F.lower(t))), "lower(p_type[1]) || p_type[2:] || upper(p_type[1]) || lower(p_type[2:])")
case("formatnum_native", "orders", "o_orderkey", "cast(o_orderkey * 1000 as string)", C.grouped, "format('{:,}', o_orderkey * 1000)")
case("padding_native", "part", "p_partkey", "cast(p_size as string)", lambda t: F.concat(C.padded_left(t, 4), C.padded_right(t, 4, "x"), C.padded_left(t, 1)), "lpad(p_size::VARCHAR, 4, '0') || rpad(p_size::VARCHAR, 4, 'x') || p_size")
case("urlencode_native", "part", "p_partkey", "p_type", C.form_encoded, "replace(p_type, ' ', '%20')")
case("age_native", "orders", "o_orderkey", "to_date(o_orderdate)", lambda d: C.age(d, F.lit(dt.date(2024, 6, 15))), AGE)
case("date_native", "orders", "o_orderkey", "to_date(o_orderdate)", lambda d: F.concat_ws(";", C.written_date(d), C.written_date(d, True)), f"{MDY} || ';' || {DMY}")

# filters and small measures

case("category_name", NATIONS, "n_nationkey", "concat('Category: ', n_name, ' ')", C.category_name, "n_name")
case("cleanup_whitespace", "part", "p_partkey", "concat('\\n\\n', p_name, '   x\\n \\n\\n\\n', p_brand, ' ()\\n|row\\n*\\nCategory:Z\\nreflist\\n')", U.cleaned, f"p_name || ' x' || {NL} || {NL} || p_brand || {NL} || {NL}")
case("cleanup_native", "part", "p_partkey", "concat('\\n\\n', p_name, '   x\\n \\n\\n\\n', p_brand, ' ()\\n|row\\n*\\nCategory:Z\\nreflist\\n')", C.cleaned_flat, f"p_name || ' x' || {NL} || {NL} || p_brand || {NL} || {NL}")
case("file_sizes", "orders", "o_orderkey", "cast(o_orderkey * o_orderkey as double)", C.file_size, "CASE WHEN o_orderkey * o_orderkey < 1024 THEN o_orderkey * o_orderkey || ' B' WHEN o_orderkey * o_orderkey < 1048576 THEN printf('%.1f KB', o_orderkey * o_orderkey / 1024.0) WHEN o_orderkey * o_orderkey < 1073741824 THEN printf('%.1f MB', o_orderkey * o_orderkey / 1048576.0) ELSE printf('%.2f GB', o_orderkey * o_orderkey / 1073741824.0) END")
case("durations", "orders", "o_orderkey", "o_orderkey", C.duration, "printf('%02d:%02d:%02d', o_orderkey // 3600, o_orderkey % 3600 // 60, o_orderkey % 60)")
case("article_estimate", "orders", "o_orderkey", "o_orderkey * 4096", C.articles_from_size, "CAST(floor(o_orderkey * 4096 / 1048576.0 * 200) AS BIGINT)")
case("cache_fresh", "events", "event_id", "ts", lambda t: C.fresh(t, F.lit(dt.datetime(2024, 1, 20)), 10), "ts > TIMESTAMP '2024-01-20' - INTERVAL 10 DAY")
case("output_names", "part", "p_partkey", "p_size", lambda n: F.concat(dumps.output_name("corpus", n), F.lit(" "), dumps.output_name("corpus", n, rotated=False, json=True)), "'corpus-' || p_size || '.txt corpus.jsonl'")

MIXED = "concat(CASE n_nationkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'Talk:' WHEN 2 THEN 'カテゴリ:' ELSE 'Star Wars: ' END, n_name)"


@query("SELECT n_nationkey FROM nation WHERE n_nationkey % 4 IN (0, 3)")
def namespace_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sourced(spark, sf_dir, "nation", "n_nationkey", f"{MIXED} AS title").where(C.is_article("title")).select("n_nationkey")


@query("SELECT n_nationkey FROM nation WHERE n_nationkey % 4 = 0")
def main_namespace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sourced(spark, sf_dir, "nation", "n_nationkey", f"{MIXED} AS title").where(C.main_namespace("title")).select("n_nationkey")


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN r_name END AS target, n_nationkey % 2 = 0 AS redirect FROM " + NATIONS)
def redirect_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = "CASE WHEN n_nationkey % 2 = 0 THEN concat(' #weiterleitung [[', r_name, ']]') ELSE concat('#x ', n_name) END AS text"
    return sourced(spark, sf_dir, NATIONS, "n_nationkey", text).select("n_nationkey", C.redirect_target("text").alias("target"), C.is_redirect("text").alias("redirect"))


# articles

ARTICLE = (
    f"concat({Q3}, c_name, {Q3}, ' is in [[', n_name, '|', c_mktsegment, ']].<ref>r</ref>\\n\\n== Account ==\\nBalance {{{{convert|100|C|F}}}}.\\n* item\\n{{|\\n| x\\n|}}\\n=== ', c_mktsegment,"
    " ' ===\\n{{Infobox\\n| a = b\\n}}\\nMore.\\n[[Category:', n_name, ']]\\n[[Category:', r_name, '|key]]\\n')"
)


#: Bytes of a table's files that a task's scanner is given: some 50,000 short rows, seconds of work.
TASK_BYTES = 1 << 20


def spread(spark: SparkSession, sf_dir: str, name: str, tables: str, key: str, columns: tuple[str, ...], *made: str) -> DataFrame:
    """Rows with their key and what scanners read, made of columns of the tables. Texts are costly to scan and short in
    the files, which lie in few pieces, so that narrow rows are exchanged by key before the texts are made: over all
    cores at least, and over more tasks as the files of the table `name` grow."""
    size = table(spark, sf_dir, name)._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    tasks = max(spark.sparkContext.defaultParallelism, -(-size // TASK_BYTES))
    return sourced(spark, sf_dir, tables, key, *columns).repartition(tasks, key).selectExpr(key, *made)


def synthesized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(c_custkey, title, text): an article for each customer."""
    columns = ("c_name", "n_name", "c_mktsegment", "r_name")
    return spread(spark, sf_dir, "customer", CUSTOMERS, "c_custkey", columns, "c_name AS title", f"{ARTICLE} AS text")


BODY = f"c_name || ' is in ' || c_mktsegment || '.' || {NL} || {NL} || '==Account==' || {NL} || {NL} || 'Balance 100 °C (212 °F).' || {NL} || {NL} || '===' || c_mktsegment || '===' || {NL} || {NL} || 'More.'"


@query(f"SELECT n AS category, count(*) AS articles FROM (SELECT n_name AS n FROM {CUSTOMERS} UNION ALL SELECT r_name FROM {CUSTOMERS}) GROUP BY n")
def category_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synthesized(spark, sf_dir).select(F.explode(C.categories("text")).alias("category")).groupBy("category").agg(F.count("*").alias("articles"))


@query(f"SELECT c_custkey, n_name || '|' || r_name AS categories FROM {CUSTOMERS}")
def category_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synthesized(spark, sf_dir).select("c_custkey", F.array_join(C.categories("text"), "|").alias("categories"))


_TYPES = {"mw_paragraph": 3, "mw_blank": 1, "mw_heading": 2, "mw_unordered": 1, "mw_table": 1, "mw_ml_template": 1, "mw_link": 2}


@query("SELECT t.type, count(*) * t.n AS elements FROM customer, (VALUES " + ", ".join(f"('{k}', {n})" for k, n in _TYPES.items()) + ") t(type, n) GROUP BY t.type, t.n")
def element_type_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.exploded(synthesized(spark, sf_dir).withColumn("elements", U.elements(F.col("text"))), "c_custkey")
    return rows.groupBy("type").agg(F.count("*").alias("elements"))


@query(f"SELECT c_custkey, 'Account2|' || c_mktsegment || '3' AS headings FROM {CUSTOMERS}")
def headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = synthesized(spark, sf_dir).withColumn("elements", U.elements(F.col("text")))
    return rows.select("c_custkey", F.array_join(F.transform(A.headings(), lambda h: F.concat(h["name"], h["level"].cast("string"))), "|").alias("headings"))


@query(f"SELECT c_custkey, repeat(chr(39), 3) || c_name || repeat(chr(39), 3) || ' is in [[' || n_name || '|' || c_mktsegment || ']].[ref]r[/ref]' AS summary FROM {CUSTOMERS}")
def summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = synthesized(spark, sf_dir).withColumn("elements", U.elements(F.col("text")))
    return rows.select("c_custkey", A.summary().alias("summary"))


@query("SELECT name, sum(n)::BIGINT AS count FROM (SELECT 'Account' AS name, count(*) AS n FROM customer UNION ALL SELECT c_mktsegment, count(*) FROM customer GROUP BY 1) GROUP BY name ORDER BY count DESC, name LIMIT 50")
def top_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.top_sections(synthesized(spark, sf_dir).withColumn("elements", U.elements(F.col("text"))))


@query("SELECT o_orderpriority AS name, count(*) AS count FROM orders GROUP BY 1")
def section_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sourced(spark, sf_dir, "orders", "concat('x\\n== ', o_orderpriority, ' ==\\ny') AS text").withColumn("elements", U.elements(F.col("text")))
    return A.section_counts(rows)


@query("SELECT o_orderpriority AS name, 2 * count(*) AS count FROM orders GROUP BY 1")
def section_stats_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = section_stats(spark, sf_dir)
    return A.merged_counts(counts, counts)


@query("SELECT count(*) AS total_articles, (SELECT '[' || string_agg('{\"name\":\"' || p || '\",\"count\":' || n || '}', ',' ORDER BY n DESC, p) || ']' FROM (SELECT o_orderpriority AS p, count(*) AS n FROM orders GROUP BY 1)) AS top_sections FROM orders")
def section_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sourced(spark, sf_dir, "orders", "concat('== ', o_orderpriority, ' ==\\ny') AS text").withColumn("elements", U.elements(F.col("text")))
    return A.section_report(rows)


@query("SELECT c_custkey, CASE WHEN p = 0 THEN NULL WHEN p < 5 THEN 'Account' ELSE c_mktsegment END AS section, count(*) AS n FROM customer, (VALUES (0), (0), (1), (2), (3), (5), (6), (7), (8)) t(p) GROUP BY 1, 2")
def section_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.exploded(synthesized(spark, sf_dir).withColumn("elements", U.elements(F.col("text"))), "c_custkey")
    return A.section_rows(rows, "c_custkey").groupBy("c_custkey", "section").agg(F.count("*").alias("n"))


SECTIONED = "concat('Lead ', o_orderkey, '\\n== Childhood ==\\nBorn ', o_orderstatus, '\\n=== Deep ===\\nMore\\n== Career ==\\nWork ', o_orderpriority, '\\n== Notes ==\\nn')"


def sectioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark, sf_dir, "orders", "orders", "o_orderkey", ("o_orderstatus", "o_orderpriority"), f"{SECTIONED} AS text")


def _sections(name: str, options: Options, expected: dict[str, str]) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = sectioned(spark, sf_dir).withColumn("s", U.sections(F.col("text"), options))
        return rows.select("o_orderkey", *[F.col("s")[t].alias(f"s{i}") for i, t in enumerate(options.sections)])

    QUERIES[name] = run
    ORACLE_SQL[name] = "SELECT o_orderkey, " + ", ".join(f"{e} AS s{i}" for i, e in enumerate(expected.values())) + " FROM orders"


END = f" || {NL} || {NL}"
_sections("sections", Options(sections=("summary", "Career", "Nope")), {"summary": f"'Lead ' || o_orderkey{END}", "Career": f"'Work ' || o_orderpriority{END}", "Nope": "NULL::VARCHAR"})
_sections("sections_alias", Options(sections=("Early life", "references")), {"a": f"'Born ' || o_orderstatus || {NL} || {NL} || 'More'{END}", "b": f"'n'{END}"})
_sections("sections_plain_names", Options(sections=("Early life", "notes"), section_aliases=False), {"a": "NULL::VARCHAR", "b": f"'n'{END}"})
_sections("sections_min_length", Options(sections=("Career",), min_section_length=12), {"a": f"CASE WHEN length('Work ' || o_orderpriority) >= 12 THEN 'Work ' || o_orderpriority{END} END"})


@query("SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'F'")
def skip_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sourced(spark, sf_dir, "orders", "cast(o_orderkey as string) AS title", "concat('== ', CASE WHEN o_orderstatus = 'F' THEN 'Synopsis' ELSE 'x' END, ' ==\\ny') AS text")
    return A.rendered(rows, Options(mode="sections", sections=("Plot",), skip_empty=True)).agg(F.count("*").alias("n"))


def _mode(name: str, options: Options, expected: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return A.rendered(synthesized(spark, sf_dir), options)

    QUERIES[name] = run
    ORACLE_SQL[name] = f"SELECT c_name AS title, {expected} AS output FROM {CUSTOMERS}"


def _quoted(x: str) -> str:
    return f"replace({x}, {NL}, '\\n')"


CATS = "n_name || ', ' || r_name"
_mode("article_text", Options(), f"{NL} || '[[' || c_name || ']]' || {NL} || {NL} || {BODY} || {NL} || {NL} || {NL} || 'CATEGORIES: ' || {CATS} || {NL} || {NL}")
_mode("article_text_plain", Options(category=False, title=False), f"{BODY}{END}")
_mode("article_json", Options(format="json"), "'{\"title\":\"' || c_name || '\",\"categories\":[\"' || n_name || '\",\"' || r_name || '\"],\"text\":\"' || " + _quoted(BODY) + " || '\",\"redirect\":null}'")
_mode("category_json", Options(format="json", mode="category"), "'{\"title\":\"' || c_name || '\",\"categories\":[\"' || n_name || '\",\"' || r_name || '\"],\"text\":null,\"redirect\":null}'")
_mode("category_tsv", Options(mode="category"), f"c_name || chr(9) || {CATS} || {NL}")
_mode("metadata_tsv", Options(mode="metadata"), f"c_name || chr(9) || 'Account|' || c_mktsegment || chr(9) || n_name || ',' || r_name || {NL}")
_mode("metadata_json", Options(mode="metadata", format="json"), "'{\"title\":\"' || c_name || '\",\"sections\":[\"Account\",\"' || c_mktsegment || '\"],\"categories\":[\"' || n_name || '\",\"' || r_name || '\"]}'")
_mode("summary_text", Options(mode="summary", category=False), f"'TITLE: ' || c_name || {NL} || 'SECTIONS: summary' || {NL} || {NL} || c_name || ' is in ' || c_mktsegment || '.'{END}{END} || {NL}")
_mode("sections_json", Options(mode="sections", format="json", sections=("Account", "Nope"), category=False), "'{\"title\":\"' || c_name || '\",\"sections\":{\"Account\":\"Balance 100 °C (212 °F).\\n* item\\n[TABLE]\\n[INFOBOX]\\nMore.\\n\\n\",\"Nope\":null}}'")
_mode("sections_combined_json", Options(mode="sections", format="json", section_output="combined", sections=("Account", "Nope"), category=True), "'{\"title\":\"' || c_name || '\",\"text\":\"Balance 100 °C (212 °F).\\n* item\\n[TABLE]\\n[INFOBOX]\\nMore.\\n\\n\",\"sections_included\":[\"Account\"],\"categories\":[\"' || n_name || '\",\"' || r_name || '\"]}'")
_mode("sections_matched_json", Options(mode="sections", format="json", sections=("account",), category=False, show_matched_sections=True), "'{\"title\":\"' || c_name || '\",\"sections\":{\"account\":\"Balance 100 °C (212 °F).\\n* item\\n[TABLE]\\n[INFOBOX]\\nMore.\\n\\n\"},\"matched_sections\":{\"account\":\"Account\"}}'")
_mode("sections_text", Options(mode="sections", sections=("Account", "Nope")), f"'TITLE: ' || c_name || {NL} || {NL} || 'SECTION [Account]:' || {NL} || 'Balance 100 °C (212 °F).' || {NL} || '* item' || {NL} || '[TABLE]' || {NL} || '[INFOBOX]' || {NL} || 'More.' || {NL} || {NL} || {NL} || {NL} || 'SECTION [Nope]: (not found)' || {NL} || {NL} || 'CATEGORIES: ' || {CATS} || {NL} || {NL}")


@query(f"SELECT c_name AS title, '{{\"title\":\"' || c_name || '\",\"sections\":[\"Account\",\"' || c_mktsegment || '\"],\"categories\":[\"' || n_name || '\",\"' || r_name || '\"]}}' AS json, c_name || chr(9) || 'Account|' || c_mktsegment || chr(9) || n_name || ',' || r_name AS tsv FROM {CUSTOMERS}")
def metadata_native(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.metadata(A.parsed(synthesized(spark, sf_dir)))


@query(f"SELECT c_custkey, {NL} || '==Account==' || {NL} || {NL} AS heading FROM customer")
def parse_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Through SQL: the table function, called laterally."""
    U.register(spark)
    synthesized(spark, sf_dir).createOrReplaceTempView("synthesized_articles")
    return spark.sql("SELECT c_custkey, e.text AS heading FROM synthesized_articles a, LATERAL parse_wikitext(a.text) e WHERE e.type = 'mw_heading' AND e.level = 2")


@query("SELECT count(*) AS pages, count(*) FILTER (n_nationkey % 2 = 0) AS redirects, sum(CASE WHEN n_nationkey % 2 = 0 THEN 16 + strlen(n_name) ELSE strlen(n_name) END)::BIGINT AS bytes FROM nation")
def page_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.page_stats(sourced(spark, sf_dir, "nation", "CASE WHEN n_nationkey % 2 = 0 THEN concat('#REDIRECT [[', n_name, ']]  ') ELSE n_name END AS text"))


# index, lookups, cache

INDEX = "concat((o_orderkey div 100) * 1000, ':', o_orderkey, ':Title: ', o_orderkey) AS value"


def index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dumps.index_of(sourced(spark, sf_dir, "orders", INDEX))


def wanted_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sourced(spark, sf_dir, "customer", "concat('Title: ', c_custkey * 7) AS title")


@query("SELECT (o_orderkey // 100) * 1000 AS \"offset\", o_orderkey AS page_id, 'Title: ' || o_orderkey AS title FROM orders")
def index_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index(spark, sf_dir)


@query("SELECT 'Title: ' || o_orderkey AS title, o_orderkey AS page_id FROM orders WHERE o_orderkey IN (SELECT c_custkey * 7 FROM customer)")
def title_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.by_titles(index(spark, sf_dir), wanted_titles(spark, sf_dir)).select("title", "page_id")


@query("SELECT 'Title: ' || c_custkey * 7 AS title FROM customer WHERE c_custkey * 7 NOT IN (SELECT o_orderkey FROM orders)")
def missing_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.missing_titles(wanted_titles(spark, sf_dir), index(spark, sf_dir))


@query("SELECT DISTINCT (o_orderkey // 100) * 1000 AS \"offset\" FROM orders WHERE o_orderkey IN (SELECT c_custkey * 7 FROM customer)")
def streams_needed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.streams_needed(index(spark, sf_dir), wanted_titles(spark, sf_dir))


@query("SELECT o AS \"offset\", coalesce(lead(o) OVER (ORDER BY o), -1) AS next_offset FROM (SELECT DISTINCT (o_orderkey // 100) * 1000 AS o FROM orders)")
def stream_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.stream_ranges(index(spark, sf_dir)).fillna(-1)


@query("SELECT o_orderkey AS page_id FROM orders WHERE o_orderkey // 100 IN (SELECT DISTINCT o_orderkey // 100 AS s FROM orders ORDER BY s LIMIT 3)")
def first_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.first_streams(index(spark, sf_dir), 3).select("page_id")


@query("SELECT o_orderkey AS page_id FROM orders ORDER BY o_orderkey // 100, o_orderkey LIMIT 25")
def first_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.first_articles(index(spark, sf_dir), 25).select("page_id")


@query("SELECT o_orderkey AS page_id FROM orders ORDER BY md5('7|Title: ' || o_orderkey), 'Title: ' || o_orderkey LIMIT 25")
def random_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.random_articles(index(spark, sf_dir), 25, seed=7).select("page_id")


@query("SELECT o_custkey AS owner, max(o_orderkey) AS page_id FROM orders GROUP BY 1")
def last_title_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sourced(spark, sf_dir, "orders", "cast(o_custkey as string) AS title", "o_orderkey AS page_id", "o_custkey AS owner")
    return R.last_entries(rows, "page_id").select("owner", "page_id")


@query("SELECT page_id, title, 'Balance of ' || page_id || ' & <more>' AS text FROM (SELECT c_custkey AS page_id, c_name AS title FROM customer WHERE c_custkey % 3 <> 0)")
def dump_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers written as an XML dump and read back; every third is a redirect."""
    body = "CASE WHEN c_custkey % 3 = 0 THEN '#REDIRECT [[x]]' ELSE concat('Balance of ', c_custkey, ' &amp; &lt;more&gt;') END"
    xml = f"concat('<page><title>', c_name, '</title><ns>0</ns><id>', c_custkey, '</id><revision><text bytes=\"1\">', {body}, '</text></revision></page>') AS value"
    path = scratch.place(spark) + "/dump.xml"
    sourced(spark, sf_dir, "customer", xml).write.text(path)
    return A.main_pages(dumps.pages(spark, path)).select("page_id", "title", "text")


@query("SELECT count(*) AS lines, sum(strlen(p_name || chr(9) || p_brand))::BIGINT AS bytes FROM part WHERE p_size % 5 <> 0")
def corpus_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records written as text, blank ones left out, and read back."""
    path = scratch.place(spark)
    dumps.write_corpus(sourced(spark, sf_dir, "part", "CASE WHEN p_size % 5 = 0 THEN ' \\n' ELSE concat(p_name, '\\t', p_brand) END AS output"), path)
    return spark.read.text(path).agg(F.count("*").alias("lines"), F.sum(F.octet_length("value")).alias("bytes"))


@query(
    "SELECT source, doc_id, ((coalesce(sum(strlen(text)) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) // 20000)::BIGINT + 1 AS bucket FROM documents"
)
def output_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.size_buckets(table(spark, sf_dir, "documents"), "text", "doc_id", 20000, "source").select("source", "doc_id", "bucket")


@query("SELECT event_type, count(*) AS entries, min(ts) AS oldest, max(ts) AS newest FROM events GROUP BY 1")
def cache_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.cache_stats(table(spark, sf_dir, "events").withColumnRenamed("ts", "cached_at"), "event_type")


@query("SELECT event_id, user_id FROM events WHERE NOT ts < TIMESTAMP '2024-01-20' - INTERVAL 10 DAY")
def cache_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumnRenamed("ts", "cached_at")
    kept, _ = R.without_expired(rows, rows.select("event_id"), "2024-01-20", 10, key="event_id", edge_key="event_id")
    return kept.select("event_id", "user_id")


@query("SELECT c_custkey AS key, CASE WHEN c_custkey % 2 = 0 THEN 'new' ELSE 'old' END AS state FROM customer")
def cache_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = sourced(spark, sf_dir, "customer", "c_custkey AS key", "'old' AS state")
    return R.upserted(old, sourced(spark, sf_dir, "customer", "c_custkey AS key", "'new' AS state").where("key % 2 = 0"), "key")


# category graph


def graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Edges world > region > nation, and one from each nation back to its region (cycles); customers as pages; roots."""
    down = sourced(spark, sf_dir, NATIONS, "r_name AS parent", "n_name AS child")
    top = sourced(spark, sf_dir, "region", "'World' AS parent", "r_name AS child")
    edges = down.union(top).union(down.select("child", "parent"))
    members = sourced(spark, sf_dir, "customer JOIN nation ON c_nationkey = n_nationkey", "n_name AS category", "c_name AS page")
    return edges, members, sourced(spark, sf_dir, "region", "r_name AS name").union(spark.createDataFrame([("World",)], "name string"))


_GRAPH = (
    "WITH RECURSIVE edges AS (SELECT r_name AS parent, n_name AS child FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT 'World', r_name FROM region UNION ALL SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey),"
    " roots AS (SELECT r_name AS name FROM region UNION ALL SELECT 'World'), members AS (SELECT n_name AS category, c_name AS page FROM customer JOIN nation ON c_nationkey = n_nationkey),"
    " walk AS (SELECT name AS root, name, 0 AS depth FROM roots UNION SELECT w.root, e.child, w.depth + 1 FROM walk w JOIN edges e ON e.parent = w.name WHERE w.depth < 3),"
    " tree AS (SELECT root, name, min(depth) AS depth FROM walk GROUP BY 1, 2)"
)


@query(f"{_GRAPH} SELECT root, name, depth FROM tree")
def category_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, _, roots = graph(spark, sf_dir)
    return R.reachable(edges, roots, 3)


@query(f"{_GRAPH} SELECT DISTINCT root, page FROM tree JOIN members ON category = name")
def category_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.pages_within(*graph(spark, sf_dir), 3)


@query(f"{_GRAPH} SELECT root, count(DISTINCT name) AS categories, count(DISTINCT name) - 1 AS subcategories, count(page) AS total_articles, count(DISTINCT page) AS distinct_articles FROM tree LEFT JOIN members ON category = name GROUP BY root")
def category_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.preview(*graph(spark, sf_dir), 3)


@query("SELECT 'World' AS root, 'World' AS path, 0 AS depth UNION ALL SELECT 'World', 'World>' || r_name, 1 FROM region UNION ALL SELECT 'World', 'World>' || r_name || '>' || n_name, 2 FROM nation JOIN region ON n_regionkey = r_regionkey")
def category_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, _, roots = graph(spark, sf_dir)
    return R.category_tree(edges, roots.where("name = 'World'"), 3).select("root", F.array_join("path", ">").alias("path"), "depth")


_GRAPH_10 = _GRAPH.replace("w.depth < 3", "w.depth < 10")


@query(f"{_GRAPH_10} SELECT root, name, depth FROM tree")
def category_reach_deep(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, _, roots = graph(spark, sf_dir)
    return R.reachable(edges, roots, 10)


@query(
    f"{_GRAPH} SELECT t.root, t.name, (SELECT min(e.parent) FROM edges e JOIN tree u ON u.name = e.parent AND u.root = t.root AND u.depth = t.depth - 1 WHERE e.child = t.name) AS parent, t.depth,"
    " (SELECT count(*) FROM members WHERE category = t.name) AS page_count, true AS cached FROM tree t"
)
def category_counted_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.counted_tree(*graph(spark, sf_dir), 3)


_FRESH = "CASE WHEN n_nationkey % 2 = 0 THEN TIMESTAMP '2024-06-10' ELSE TIMESTAMP '2024-01-01' END"


def category_cache(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nations as cached categories, every second one too old; region edges; customers as pages."""
    cache = sourced(spark, sf_dir, "nation", "n_name AS name", f"{_FRESH} AS cached_at")
    edges = sourced(spark, sf_dir, NATIONS, "n_name AS parent", "r_name AS child")
    return cache, edges, sourced(spark, sf_dir, "customer JOIN nation ON c_nationkey = n_nationkey", "n_name AS category", "c_name AS page")


@query(
    f"SELECT n_name AS name, coalesce((SELECT string_agg(c_name, '|' ORDER BY c_name) FROM customer WHERE c_nationkey = n_nationkey), '') AS pages, r_name AS subcats FROM {NATIONS} WHERE n_nationkey % 2 = 0 AND n_nationkey < 20"
)
def cache_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = sourced(spark, sf_dir, "nation", "concat('Category: ', n_name) AS name").where("name is not null")
    few = names.join(sourced(spark, sf_dir, "nation", "concat('Category: ', n_name) AS name", "n_nationkey").where("n_nationkey < 20").select("name"), "name")
    got = R.cached(*category_cache(spark, sf_dir), few, "2024-06-15", 7)
    return got.select("name", F.array_join("pages", "|").alias("pages"), F.array_join("subcats", "|").alias("subcats"))


@query("SELECT count(*) AS removed FROM nation WHERE n_nationkey % 2 <> 0")
def cache_expired_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.expired_count(category_cache(spark, sf_dir)[0], "2024-06-15", 7)


@query("WITH o AS (SELECT DISTINCT (o_orderkey // 100) * 1000 AS o FROM orders), m AS (SELECT max((o_orderkey // 100) * 1000) AS m FROM orders WHERE o_orderkey IN (SELECT c_custkey * 7 FROM customer WHERE c_custkey < 900)) SELECT o AS \"offset\" FROM o, m WHERE o <= m")
def streams_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    titles = sourced(spark, sf_dir, "customer", "concat('Title: ', c_custkey * 7) AS title", "c_custkey").where("c_custkey < 900")
    return R.streams_through(index(spark, sf_dir), titles).select("offset")


@query("SELECT o_orderkey AS page_id, 'Title: ' || o_orderkey AS title FROM orders WHERE o_orderkey IN (SELECT c_custkey * 3 FROM customer)")
def id_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.by_ids(index(spark, sf_dir), sourced(spark, sf_dir, "customer", "c_custkey * 3 AS page_id")).select("page_id", "title")


@query("SELECT count(*) AS articles FROM orders")
def articles_from_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index(spark, sf_dir).agg(F.count("*").alias("articles"))


case("eta_seconds", "orders", "o_orderkey", "o_orderkey % 200", lambda n: C.eta(n, F.lit(150), F.lit(60.0)), "CASE WHEN o_orderkey % 200 BETWEEN 1 AND 150 THEN (150 - o_orderkey % 200) * 60.0::DOUBLE / (o_orderkey % 200) END")
case(
    "eta_texts", "orders", "o_orderkey", "CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE cast(o_orderkey * 37 - 50 as double) END", C.eta_text,
    "CASE WHEN o_orderkey % 11 = 0 OR o_orderkey * 37 < 50 THEN '--:--:--' WHEN (o_orderkey * 37 - 50) // 3600 > 99 THEN '>99h' WHEN o_orderkey * 37 - 50 >= 3600 THEN printf('%02d:%02d:%02d', (o_orderkey * 37 - 50) // 3600, (o_orderkey * 37 - 50) % 3600 // 60, (o_orderkey * 37 - 50) % 60) ELSE printf('%02d:%02d', (o_orderkey * 37 - 50) // 60, (o_orderkey * 37 - 50) % 60) END",
)
case("numbered_files", "part", "p_partkey", "concat('corpus-', p_size)", lambda n: C.numbered(n, F.lit(4)), "'corpus-' || lpad(p_size::VARCHAR, 4, '0') || '.txt'")


# files: dumps, streams, sinks, caches

PAGE_XML = "concat('<page><title>', n_name, '</title><ns>0</ns><id>', n_nationkey, '</id><revision><text>Nation ', n_nationkey, ' of [[', r_name, ']] &amp; more</text></revision></page>')"


def multistream(spark: SparkSession, sf_dir: str) -> tuple[str, str]:
    """A multistream dump of the 25 nations with a stream for each region, and its index: a fixture of fixed size, so
    that it may pass through the driver."""
    rows = sourced(spark, sf_dir, NATIONS, "n_regionkey", "n_nationkey", "n_name", f"{PAGE_XML} AS xml").orderBy("n_nationkey").toPandas()
    folder, at, lines, parts = scratch.place(spark), 0, [], [bz2.compress(b"<mediawiki>\n")]
    at = len(parts[0])
    for _, group in rows.groupby("n_regionkey"):
        lines += [f"{at}:{k}:{name}" for k, name in zip(group["n_nationkey"], group["n_name"], strict=True)]
        parts.append(bz2.compress("\n".join(group["xml"]).encode()))
        at += len(parts[-1])
    parts.append(bz2.compress(b"</mediawiki>\n"))
    dumps.write_bytes(f"{folder}/nations-multistream.xml.bz2", b"".join(parts))
    dumps.write_bytes(f"{folder}/index.txt", "\n".join(lines).encode())
    return f"{folder}/nations-multistream.xml.bz2", f"{folder}/index.txt"


_NATION_TEXT = "'Nation ' || n_nationkey || ' of [[' || r_name || ']] & more'"


@query(f"SELECT n_nationkey AS page_id, n_name AS title, {_NATION_TEXT} AS text FROM {NATIONS}")
def bz2_dump_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bzip2 multistream dump, read by blocks."""
    return dumps.pages(spark, multistream(spark, sf_dir)[0]).select("page_id", "title", "text")


@query("SELECT page_id, title, 'Balance of ' || page_id AS text FROM (SELECT c_custkey AS page_id, c_name AS title FROM customer)")
def bz2_split_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as a folder of several bzip2 parts, which are read in parallel."""
    xml = "concat('<page><title>', c_name, '</title><id>', c_custkey, '</id><revision><text>Balance of ', c_custkey, '</text></revision></page>') AS value"
    path = scratch.place(spark)
    rows = spread(spark, sf_dir, "customer", "customer", "c_custkey", ("c_name",), xml)
    rows.select("value").write.option("compression", "bzip2").text(f"{path}/dump.xml.bz2")
    return dumps.pages(spark, f"{path}/dump.xml.bz2").select("page_id", "title", "text")


@query(f"SELECT n_nationkey AS page_id, n_name AS title, {_NATION_TEXT} AS text FROM {NATIONS} WHERE n_nationkey % 3 = 0")
def stream_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles by title: only the streams that hold them are read."""
    dump, lines = multistream(spark, sf_dir)
    titles = sourced(spark, sf_dir, "nation", "n_name AS title", "n_nationkey").where("n_nationkey % 3 = 0")
    return dumps.articles(spark, dump, dumps.index(spark, lines), titles).select("page_id", "title", "text")


@query(f"SELECT n_nationkey AS page_id, n_name AS title FROM {NATIONS} WHERE n_regionkey < 2")
def stream_pages_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of given byte ranges through the data source."""
    dump, lines = multistream(spark, sf_dir)
    spark.dataSource.register(dumps.StreamSource)
    ranges = R.stream_ranges(dumps.index(spark, lines)).orderBy("offset").limit(2).toPandas()
    streams = ",".join(f"{int(a)}-{int(z)}" for a, z in zip(ranges["offset"], ranges["next_offset"], strict=True))
    return spark.read.format("wikistreams").option("streams", streams).option("tasks", "2").load(dump).select("page_id", "title")


@query("SELECT * FROM (VALUES ('bad.bz2', 'not bzip2'), ('broken.bz2', 'corrupt'), ('empty.bz2', 'empty'), ('nations-multistream.xml.bz2', NULL), ('short.bz2', 'too small'), ('size.bz2', 'bad block size'), ('text.bz2', 'not XML'), ('version.bz2', 'unknown version')) t(file, problem)")
def bz2_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A good dump and seven bad ones."""
    dump, _ = multistream(spark, sf_dir)
    folder = dump.rpartition("/")[0]
    long = bz2.compress(b"plain words, no markup")
    for name, content in {"bad": b"x" * 40, "broken": b"BZh9" + b"y" * 40, "empty": b"", "short": b"BZh9", "size": b"BZhx" + b"y" * 40, "text": long, "version": b"BZ09" + b"y" * 40}.items():
        dumps.write_bytes(f"{folder}/{name}.bz2", content)
    return dumps.bz2_checked(spark, f"{folder}/*.bz2").select(F.substring_index("path", "/", -1).alias("file"), "problem")


@query("SELECT * FROM (VALUES ('index.txt'), ('nations-multistream.xml.bz2')) t(file)")
def files_collected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dumps.files(spark, multistream(spark, sf_dir)[0].rpartition("/")[0]).select(F.substring_index("path", "/", -1).alias("file"))


@query("SELECT n_nationkey AS page_id, n_name AS title FROM nation")
def index_cached(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index through its cache: made at the first call, read at the second."""
    _, lines = multistream(spark, sf_dir)
    cache = scratch.place(spark)
    index_cache.load(spark, lines, cache)
    if not index_cache.valid(spark, lines, cache):
        raise ValueError("the cache that was just made isn't valid")
    return index_cache.load(spark, lines, cache).select("page_id", "title")


_ROTATED = "SELECT p_partkey, strlen(p_name || ' ' || p_partkey) + 1 AS b FROM part"


@query(f"SELECT 'parts-' || f || '.txt' AS file, count(*) AS records, sum(b)::BIGINT AS bytes FROM (SELECT b, floor(coalesce(sum(b) OVER (ORDER BY p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / 10485)::BIGINT + 1 AS f FROM ({_ROTATED})) GROUP BY f")
def corpus_rotated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records written to base-1.txt, base-2.txt ... of a hundredth of a megabyte, and counted by file."""
    folder = scratch.place(spark)
    sinks.write_rotated(sourced(spark, sf_dir, "part", "p_partkey", "concat(p_name, ' ', p_partkey) AS output"), folder, "parts", order="p_partkey", file_mb=0.01)
    read = spark.read.text(f"{folder}/parts-*.txt").select(F.substring_index(F.input_file_name(), "/", -1).alias("file"), "value")
    return read.groupBy("file").agg(F.count("*").alias("records"), F.sum(F.octet_length("value") + 1).cast("long").alias("bytes"))


@query("SELECT n_name AS title, 'nations.jsonl' AS file FROM nation")
def corpus_single_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All records in one file of JSON lines."""
    folder = scratch.place(spark)
    rows = sourced(spark, sf_dir, "nation", "n_nationkey", "to_json(named_struct('title', n_name)) AS output")
    sinks.write_rotated(rows, folder, "nations", order="n_nationkey", file_mb=0, json=True)
    return spark.read.schema("title string").json(f"{folder}/nations.jsonl").select("title", F.substring_index(F.input_file_name(), "/", -1).alias("file"))


@query(f"SELECT o_orderkey, 'Born ' || o_orderstatus || {NL} || {NL} || 'More'{END} AS result FROM orders")
def sections_alias_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aliases from a file: a name that no built-in group has."""
    path = scratch.place(spark)
    dumps.write_bytes(path, b"# names of sections\nYouth and origins:\n  - Childhood\n  - 'Upbringing'\nWork: [Career, Jobs]\n")
    options = Options(sections=("Youth and origins",), aliases=settings.aliases(path.removeprefix("file:")))
    return sectioned(spark, sf_dir).select("o_orderkey", U.sections(F.col("text"), options)["Youth and origins"].alias("result"))


@query(f"SELECT n_name AS title, r_name AS category FROM {NATIONS}")
def stream_dump_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dump that arrived in a folder, taken in as a stream of (title, category)."""
    folder = scratch.place(spark)
    xml = "concat('<page><title>', n_name, '</title><id>', n_nationkey, '</id><revision><text>x [[Category:', r_name, ']]</text></revision></page>') AS xml"
    dumps.write_bytes(f"{folder}/in/dump.xml", "\n".join(sourced(spark, sf_dir, NATIONS, xml).toPandas()["xml"]).encode())
    return arriving.run_to(arriving.arriving_categories(arriving.arriving_dump(spark, f"{folder}/in")), f"{folder}/out", f"{folder}/state")


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, count(*) AS count FROM events GROUP BY 1 HAVING time_bucket(INTERVAL 1 DAY, ts) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)")
def stream_arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by day with a watermark: the days that are closed."""
    folder = scratch.place(spark)
    table(spark, sf_dir, "events").select("event_id", "ts").write.parquet(f"{folder}/in")
    rows = spark.readStream.schema("event_id long, ts timestamp").parquet(f"{folder}/in")
    return arriving.run_to(arriving.arrivals(rows, "ts"), f"{folder}/out", f"{folder}/state")


def _sql_function(name: str, function: str, source: str, expected: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        U.register(spark)
        return sourced(spark, sf_dir, "part", "p_partkey", f"{function}({source}) AS result")

    QUERIES[name] = run
    ORACLE_SQL[name] = f"SELECT p_partkey, {expected} AS result FROM part"


_sql_function("sql_expand", "wiki_expand", "concat('{{circa|', p_size, '}}')", "'c. ' || p_size")
_sql_function("sql_evaluate", "wiki_evaluate", "concat('{{#expr:', p_size, '+1}}')", "(p_size + 1)::VARCHAR")
_sql_function("sql_links", "wiki_links", "concat('[[a|', p_name, ']]')", "p_name")
_sql_function("sql_clean", "wiki_clean", "concat(p_name, '   ', p_brand)", f"p_name || ' ' || p_brand || {NL} || {NL}")
_sql_function("sql_plain", "wiki_plain", f"concat({Q3}, p_name, {Q3}, ' [[x|', p_brand, ']]')", "p_name || ' ' || p_brand")
_sql_function("sql_entities", "wiki_entities", "concat(p_name, '&amp;', p_brand)", "p_name || '&' || p_brand")


# the flagship


@query(f"SELECT n_name AS category, count(*) AS articles, 2 * count(*) AS headings, sum(length({BODY}))::BIGINT AS characters FROM {CUSTOMERS} GROUP BY 1")
def corpus_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles parsed and put out as plain text, then profiled by their first category."""
    rows = A.parsed(A.main_pages(synthesized(spark, sf_dir)))
    out = rows.select(
        F.col("categories")[0].alias("category"), F.size(A.headings()).alias("h"), U.rendered(F.col("title"), F.col("text"), Options(category=False, title=False)).alias("output")
    )
    return out.groupBy("category").agg(F.count("*").alias("articles"), F.sum("h").alias("headings"), F.sum(F.length(F.rtrim(F.regexp_replace("output", r"\s+\z", "")))).alias("characters"))
