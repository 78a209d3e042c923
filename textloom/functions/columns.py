"""Native Column expressions: they stay in the JVM and in whole-stage code generation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.functions import words as W


def _quoted(x: str) -> str:
    return "".join("\\" + c if c in r"\.[]{}()*+-?^$|#" else c for c in x)


def _any(names) -> str:
    return "|".join(_quoted(x) for x in sorted(names, key=lambda x: (-len(x), x)))


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def replaced(text: Column | str, pattern: str, by: str = "") -> Column:
    return F.regexp_replace(_c(text), F.lit(pattern), F.lit(by))


# filters


def valid_text(text: Column | str) -> Column:
    """Invalid bytes dropped."""
    return F.regexp_replace(F.make_valid_utf8(_c(text)), "�", "")


def main_namespace(title: Column | str) -> Column:
    """The crude filter: no colon."""
    return ~F.contains(_c(title), F.lit(":"))


def is_article(title: Column | str) -> Column:
    """No prefix that names another namespace; null and empty titles pass."""
    return F.coalesce(~F.rlike(_c(title), F.lit(rf"(?iu)^\s*(?:{_any(W.NON_ARTICLE)})\s*:")), F.lit(True))


def is_redirect(text: Column | str) -> Column:
    head = F.ltrim(F.substring(_c(text), 1, 200))
    return F.rlike(head, F.lit("^[#＃]")) & F.contains(head, F.lit("[["))


def redirect_target(text: Column | str) -> Column:
    found = F.regexp_extract(_c(text), rf"(?iu)[#＃](?:{_any(W.REDIRECT)})\s*(?::\s*)?\[{{2}}([^\]]+)\]{{2}}", 1)
    return F.when(found != "", found)


# marks


def without_tags(text: Column | str) -> Column:
    return replaced(text, "<[^<>]*>")


def without_comments(text: Column | str) -> Column:
    return replaced(text, r"(?s)<!--.*?-->")


def without_self_closed(text: Column | str) -> Column:
    return replaced(text, "<[^<>]+/>")


def without_switches(text: Column | str) -> Column:
    return replaced(text, rf"(?iu){_any(W.SWITCHES)}")


def without_emphasis(text: Column | str) -> Column:
    return replaced(text, r"(''+)(.+?)\1", "$2")


def without_rules(text: Column | str) -> Column:
    return replaced(text, r"(?md)^\s*-{4,}\s*$")


def dashes(text: Column | str) -> Column:
    return replaced(text, r"\{(?:–|ndash|mdash)\}", "–")


def references(text: Column | str) -> Column:
    text = replaced(text, "(?i)<br ?/>", "\n")
    text = replaced(text, "(?i)<ref[^>]*/>")
    return replaced(replaced(text, "(?i)<ref[^>]*>", "[ref]"), "(?i)</ref>", "[/ref]")


def without_references(text: Column | str) -> Column:
    return replaced(text, r"(?s)\[ref\](.*?)\[/ref\]")


def between(text: Column | str, left: str, right: str) -> Column:
    """Deletes pairs that hold neither bracket."""
    inside = "".join(_quoted(x) for x in sorted(set(left + right)))
    return replaced(text, f"{_quoted(left)}[^{inside}]*{_quoted(right)}")


def tag_marker(text: Column | str, kind: str, tag: str | None = None) -> Column:
    return replaced(text, rf"(?is)<{tag or kind}[^>]*>.*?</{tag or kind}>", f"[{kind.upper()}]")


def categories(text: Column | str) -> Column:
    pattern = rf"(?iu)[{{\[|\x08](?:{_any(W.CATEGORY)})\s*:([^|\]}}]+)[|\]}}]"
    return F.array_distinct(F.regexp_extract_all(_c(text), F.lit(pattern), F.lit(1)))


def pipe_trick(target: Column | str) -> Column:
    return F.trim(replaced(replaced(replaced(target, r"^[^:]+:"), r"\s*\([^)]+\)\s*$"), r"\s*,.*$"))


def flat_links(text: Column | str) -> Column:
    """[[a]] and [[a|b]] without links, files or categories inside."""
    return replaced(replaced(text, r"\[\[[^\[\]|]*\|([^\[\]]+)\]\]", "$1"), r"\[\[([^\[\]|]*)\]\]", "$1")


def flat_external_links(text: Column | str) -> Column:
    return replaced(replaced(text, r"\[(\S+) ([^\[\]]*)\]", "$2"), r"\[([^\[\]\s]*)\]", "$1")


def unbalanced_links(line: Column | str) -> Column:
    return F.regexp_count(_c(line), F.lit(r"\[\[")) > F.regexp_count(_c(line), F.lit(r"\]\]"))


def heading_level(line: Column | str) -> Column:
    n = F.length(F.regexp_extract(_c(line), "^(=+)", 1))
    return F.when(n > 0, n).otherwise(2)


def heading_text(line: Column | str) -> Column:
    return F.trim(replaced(replaced(line, r"^\s*=+\s*"), r"\s*=+\s*$"))


def list_text(line: Column | str) -> Column:
    return replaced(line, r"\A[ :;#*]+")


# white space and remnants: the part of the clean-up that needs no nesting

_STEPS = [
    (r"\[ref\]\s*\[/ref\]", ""), (r"(?md)^File:.+$", ""), (r"(?md)^\|.*$", ""), (r"(?md)\{\{.*$", ""), (r"(?md)^.*\}\}", ""), (r"(?md)\{\|.*$", ""), (r"(?md)^.*\|\}", ""),
    (r"\n{3,}", "\n\n"), (r"\n(?:[\t ]*\n){2,}", "\n\n"), (r"(?<=[^\n]) {2,}", " "), (r"（\s*）|\(\s*\)", ""), (r"\|{2,}", ""), (r"(?md)\|\s*$", ""), (r"(?md)^[^\S\n]*\|[^|\n]*$\n?", ""),
    (rf"(?miud)^\s*(?:{_any(W.REMNANTS)}|notelist\d+)\s*$", ""), (rf"(?iu)\{{\{{\s*(?:{_any(W.SORT_WORDS)})[^}}]*\}}\}}", ""), (rf"(?miud)^(?:{_any(W.SORT_WORDS)})[^\n]*$", ""),
    (rf"(?iu){_any(W.SWITCHES)}", ""), (r":[a-z]{2,3}:(?=[^\s\]])", ""), (rf"(?miud)^\s*(?:{_any(W.AUTHORITY)})\s*$", ""),
    (rf"(?miud)^\s*(?:\*\s*)?(?!CATEGORIES)(?:{_any(W.CATEGORY)}):[^\n]+$", ""), (r"(?md)^\s*\*\s*$", ""), (r"\n{3,}", "\n\n"),
]


def cleaned_flat(text: Column | str) -> Column:
    out = reduce(lambda c, s: replaced(c, *s), _STEPS, _c(text))
    return F.concat(replaced(out, r"\A\s+|\s+\z"), F.lit("\n\n"))


# magic words and string functions


def base_name(title: Column | str) -> Column:
    return replaced(title, r"/[^/]*$")


def root_name(title: Column | str) -> Column:
    return F.substring_index(_c(title), "/", 1)


def sub_name(title: Column | str) -> Column:
    return F.substring_index(_c(title), "/", -1)


def first_lower(text: Column | str) -> Column:
    return F.concat(F.lower(F.substring(_c(text), 1, 1)), F.substring(_c(text), F.lit(2), F.length(_c(text))))


def first_upper(text: Column | str) -> Column:
    return F.concat(F.upper(F.substring(_c(text), 1, 1)), F.substring(_c(text), F.lit(2), F.length(_c(text))))


def grouped(number: Column | str) -> Column:
    """Thousands commas in the integer part."""
    whole = F.substring_index(_c(number), ".", 1)
    rest = F.substring(_c(number), F.length(whole) + 1, F.length(_c(number)))
    return F.concat(replaced(whole, r"(?<=\d)(?=(?:\d{3})+(?!\d))", ","), rest)


def padded_left(text: Column | str, size: int, fill: str = "0") -> Column:
    return F.when(F.length(_c(text)) >= size, _c(text)).otherwise(F.lpad(_c(text), size, fill))


def padded_right(text: Column | str, size: int, fill: str = "0") -> Column:
    return F.when(F.length(_c(text)) >= size, _c(text)).otherwise(F.rpad(_c(text), size, fill))


def form_encoded(text: Column | str) -> Column:
    return F.replace(F.url_encode(_c(text)), F.lit("+"), F.lit("%20"))


def segments(title: Column | str, count: int, first: int = 1) -> Column:
    """`count` parts between slashes from the 1-based `first`."""
    return F.array_join(F.slice(F.split(_c(title), "/"), first, count), "/")


# dates


def age(born: Column, then: Column) -> Column:
    before = F.date_format(then, "MMdd") < F.date_format(born, "MMdd")
    return F.year(then) - F.year(born) - before.cast("int")


def written_date(day: Column, day_first: bool = False) -> Column:
    return F.date_format(day, "d MMMM yyyy" if day_first else "MMMM d, yyyy")


# statistics and caches


def articles_from_size(size: Column, per_mb: int = 200) -> Column:
    return F.floor(size / F.lit(1048576.0) * per_mb).cast("long")


def file_size(size: Column) -> Column:
    """With one digit, two for gigabytes; exact halves go to the even digit."""
    units = F.when(size < 1024, F.format_string("%d B", size.cast("long"))).when(size < 1048576, F.format_string("%.1f KB", F.bround(size / 1024.0, 1)))
    return units.when(size < 1073741824, F.format_string("%.1f MB", F.bround(size / 1048576.0, 1))).otherwise(F.format_string("%.2f GB", F.bround(size / 1073741824.0, 2)))


def duration(seconds: Column) -> Column:
    h, m, s = F.floor(seconds / 3600), F.floor(seconds % 3600 / 60), F.floor(seconds % 60)
    return F.format_string("%02d:%02d:%02d", h.cast("long"), m.cast("long"), s.cast("long"))


def fresh(at: Column, now: Column, days: int) -> Column:
    return at > now - F.expr(f"interval {days} days")


def category_name(name: Column | str) -> Column:
    return F.trim(replaced(name, "^[Cc]ategory:"))


def eta(done: Column, total: Column, elapsed: Column) -> Column:
    """Seconds that are left at the rate so far; null where that can't be told."""
    known = (done > 0) & (total > 0) & (done <= total) & (elapsed > 0)
    return F.when(known, (total - done) * elapsed / done)


def eta_text(seconds: Column) -> Column:
    """hh:mm:ss, mm:ss below an hour, >99h above 99 of them; --:--:-- for null, negative or endless."""
    s = F.floor(seconds).cast("long")
    h, m, r = F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60
    text = F.when(h > 99, ">99h").when(h > 0, F.format_string("%02d:%02d:%02d", h, m, r)).otherwise(F.format_string("%02d:%02d", m, r))
    return F.when(seconds.isNull() | (seconds < 0) | F.isnan(seconds) | (seconds == float("inf")), "--:--:--").otherwise(text)


def numbered(name: Column, width: Column, end: str = "txt") -> Column:
    """A file name whose last number has `width` digits, with an ending."""
    number = F.regexp_extract(name, r"-(\d+)$", 1)
    padded = F.concat(F.regexp_extract(name, r"^(.*-)\d+$", 1), F.lpad(number, width, "0"))
    return F.concat(F.when(number == "", name).otherwise(padded), F.lit(f".{end}"))
