"""Scanners: expected texts, and equivalence with naive loops."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from textloom.functions import article as A
from textloom.functions import scan as S
from textloom.functions import templates as T

EXPANDED = {
    "{{birth date|1871|5|9}}": "May 9, 1871", "{{birth date|1871|5|9|df=y}}": "9 May 1871", "{{date|2024|6}}": "June 2024", "{{date|2024}}": "2024", "{{birth date}}": "",
    "{{convert|100|C|F}}": "100 °C (212 °F)", "{{convert|100|foo|bar}}": "100 foo", "{{convert|100|km|mi}}": "100 km (62.1 mi)", "{{convert|1,5|km|mi}}": "1 km (0.6 mi)", "{{cvt|5|kg}}": "5 kg",
    "{{circa|1500|1550}}": "c. 1500 – c. 1550", "{{marriage|Ann|1991|2011|reason=died}}": "Ann (m. 1991; d. 2011)", "{{marriage|Jane}}": "Jane", "{{unknown template|foo|bar}}": "",
    "{{lang-fr|Bonjour}}": "French: Bonjour", "{{lang|fr|Bonjour|lit=Hello}}": "Bonjour (lit. 'Hello')", "{{nihongo|Tokyo|東京|Tōkyō}}": "Tokyo (東京, Tōkyō)", "{{frac|1|1|4}}": "1+1/4", "{{as of|2020|5}}": "As of May 2020",
    "{{coord|12|7|S|130|9|W}}": "12°7′ S, 130°9′ W", "{{coord|1|2|3}}": "1, 2, 3", "{{age in days|2000|2|28|2000|3|1}}": "2", "{{age in years and days|2000|2|29|2001|2|28}}": "0 years, 365 days", "{{death date and age|2011|4|1|1940|4|2}}": "April 1, 2011 (aged 70)",
    "a {{nowrap|b {{small|c}}}} {{open": "a b c {{open", "{{reign|1}}": "", "{{sic}}": "[sic]", "{{quote|x|y}}": "x — y",
}
EVALUATED = {
    "{{#expr:17 mod 5}}": "2", "{{#expr:5=6}}": "0", "{{#expr:2^3^2}}": "512", "{{#expr:-2 + 3.5}}": "1.5", "{{#expr:1/0}}": "", "{{#expr:x}}": "", "{{#expr:not 0}}": "1", "{{#expr:1/3}}": "0.33", "{{#expr:(1}}": "",
    "{{#switch:q|p|q|r=hit}}": "hit", "{{#switch:z|p=one|q=two|rest}}": "rest", "{{#switch:x|#default=d}}": "d", "{{#if: |a|b}}": "b", "{{#ifeq:01|1.0|same|other}}": "same", "{{#ifexpr:1>2|a|b}}": "b",
    "{{#pos:abc|z}}": "", "{{#rpos:abc|z}}": "-1", "{{#sub:hello|-3|2}}": "ll", "{{#sub:hi|9}}": "", "{{#explode:k-l-m|-|-1}}": "m", "{{#padleft:7|3|0}}": "007", "{{#padright:x|3}}|": "x  |", "{{#titleparts:a/b/c|1|1}}": "b", "{{#iferror:ok}}": "ok",
    "{{#time:jS F Y, N|2024-03-22}}": "22nd March 2024, 5", "{{#time:Y|nonsense}}": "", "{{#nope:x}}": "", "{{#urlencode:a b&ü}}": "a%20b%26%C3%BC", "{{#urldecode:a+b%20c}}": "a b c", "{{#replace:aXbX|X|-}}": "a-b-", "{{#count:aaa|a}}": "3", "{{#len:äb}}": "2",
}
MAGIC = {
    "{{PAGENAMEE}}": "Test_Article", "{{formatnum:1234.56}}": "1,234.56", "{{formatnum:1,234|R}}": "1234", "{{#titleparts:U/V/W|1|2}}": "V", "{{#titleparts:A/B/C|-1}}": "A/B", "{{CURRENTTIMESTAMP}}": "20240615143045", "{{lc:ABC}}{{ucfirst:abc}}": "abcAbc",
    "{{padleft:7|3}}": "007", "{{nope}}": "{{nope}}", "{{NAMESPACE}}": "", "{{TALKPAGENAME}}": "Talk:Test Article", "{{CURRENTDAYNAME}} {{CURRENTWEEK}} {{CURRENTDOW}}": "Saturday 24 6", "{{anchorencode:a b(c}}": "a_b.28c", "{{urlencode:a é}}": "a_%C3%A9", "{{plural:2|one|two}}": "one",
}


@pytest.mark.parametrize(("source", "expected"), EXPANDED.items())
def test_templates(source, expected):
    assert T.expand_templates(source) == expected


@pytest.mark.parametrize(("source", "expected"), EVALUATED.items())
def test_parser_functions(source, expected):
    assert T.evaluate(source) == expected


@pytest.mark.parametrize(("source", "expected"), MAGIC.items())
def test_magic_words(source, expected):
    assert T.magic(source, "Test Article") == expected


def test_links():
    assert S.links("[[a]] [[b|c]] [[d|e|f]] [[Category:X|k]][[:x]]") == "a c e|f :x"
    assert S.links("[[File:a.jpg|thumb|200px|A [[cat|dog]] here]]|[[Image:b.png]]|[[ファイル:c.png|右|x=y]]") == "A dog here||"
    assert S.pipe_trick("Wikipedia:Manual of Style (dates)") == "Manual of Style" and S.pipe_trick("Paris, Texas") == "Paris"
    assert S.external_links("[http://a.com a b] [http://a.com] [ x y ]") == "a b http://a.com  (x y) "
    assert S.links("[[open") == "[[open" and S.links("close]]") == "close]]"


def test_entities():
    assert S.entities("&#x1F600;&ratio;&nbsp;&amp;lt;&#0;&#xFFFFFF;&nosuch;&amp") == "😀∶\xa0&lt;&nosuch;&amp"


def _naive(text, left, right, make):
    while (new := S._again(text, left, right, make, 1)) != text:
        text = new
    return text


@settings(max_examples=400, deadline=None)
@given(st.text("[]a|{}", max_size=20), st.sampled_from([lambda c: "", lambda c: "x", lambda c: c[1:], lambda c: c.replace("a", "")]))
def test_nested_equals_naive(text, make):
    assert S.nested(text, "[[", "]]", make) == _naive(text, "[[", "]]", make)


def test_deep_nesting_is_fast():
    n = 20000
    assert S.nested("{{" * n + "x" + "}}" * n, "{{", "}}", lambda _: "") == ""
    assert S.links("[[a]] " * n) == "a " * n


def test_cleanup_settles():
    rng = random.Random(0)
    parts = ["text", "\n", "\n\n\n", "|", "Category:X", "*", "()", "  ", "== h ==", "reflist", "__TOC__"]
    for _ in range(300):
        text = "".join(rng.choice(parts) for _ in range(12))
        once = S.cleaned(text)
        for _ in range(8):
            text, once = once, S.cleaned(once)
            assert len(once) <= len(text)
        assert once == text and once.endswith("\n\n")


def test_markers():
    text = "<math>x</math> {{Infobox|a={{b}}}} {|\n|x\n|} <ref>r</ref>"
    assert S.marks_shown(S.mark(text, S.MARKERS)) == "[MATH] [INFOBOX] [TABLE] <ref>r</ref>"
    assert S.marks_shown(S.mark(text, ())) == "  {|\n|x\n|} <ref>r</ref>"
    assert S.chosen(["math", "nope"]) == ("math",) and S.chosen(False) == () and S.chosen(None) == S.MARKERS


def test_citation():
    assert S.citation("cite web|last=Doe|first=J|title=T|date=2020-01-02") == 'Doe, J. "T". 2020.' and S.citation("cite web|url=x") == ""
    assert A.plain("x {{cite web|title=T|year=2001}}", A.Options(extract_citations=True)) == 'x "T". 2001.'
    assert A.plain("a [ref]r[/ref]b") == "a b"


ARTICLE = "'''Foo''' is [[thing|a thing]].\n\n== Early life ==\nBorn.\n* item\n=== Sub ===\nMore\n{{Infobox\n|a=b\n}} rest\n== Career ==\nText\n {|\n|x\n|}\n[[File:x|\ncap]]\n[[Category:A]] [[Category:B|key]]\n#REDIRECT [[Bar]]\n"


def test_parse():
    kinds = [e[0] for e in A.parse(ARTICLE)]
    assert kinds == ["mw_paragraph", "mw_blank", "mw_heading", "mw_paragraph", "mw_unordered", "mw_heading", "mw_paragraph", "mw_ml_template", "mw_paragraph", "mw_heading", "mw_paragraph", "mw_table", "mw_ml_link", "mw_link", "mw_redirect"]
    elements = A.parse(ARTICLE)
    assert A.headings(elements) == [("Early life", 2), ("Sub", 3), ("Career", 2)] and A.redirect(elements) == "Bar" and A.categories(ARTICLE) == ["A", "B"]
    assert A.parse("") == [] and A.summary([]) is None


def test_sections():
    found, matched = A.sections(A.parse(ARTICLE), A.Options(sections=("childhood", "Sub", "Nope")))
    assert found["childhood"] == "Born.\n* item" and found["Sub"].startswith("More") and found["Nope"] is None and matched == {"childhood": "Early life"}
    assert A.render("T", "== x ==", A.Options(mode="sections", sections=("Plot",), skip_empty=True)) is None
    found, _ = A.sections(A.parse("== A ==\nshort\n== A ==\nlonger text"), A.Options(sections=("a",), min_section_length=6))
    assert found == {"a": "longer text"}


def test_languages():
    for text, category, target in (
        ("#WEITERLEITUNG [[Ziel]]\n[[Kategorie:X]]", "X", "Ziel"), ("#REDIRECTION [[But]]\n[[Catégorie:Y]]", "Y", "But"), ("#重定向 [[目标]]\n[[分类:Z]]", "Z", "目标"), ("#ПЕРЕНАПРАВЛЕНИЕ [[Цель]]\n[[Категория:Ш]]", "Ш", "Цель"),
        ("#넘겨주기 [[목표]]\n[[분류:가]]", "가", "목표"), ("#تحويل [[هدف]]\n[[تصنيف:س]]", "س", "هدف"), ("＃転送 [[先]]\n[[カテゴリ:あ]]", "あ", "先"),
    ):
        assert A.categories(text) == [category] and A.redirect(A.parse(text)) == target
