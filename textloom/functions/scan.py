"""Scanners of nested and marked-up text: plain Python, one text at a time."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache

from textloom.functions import words as W

MARKERS = ("math", "code", "codeblock", "chem", "table", "score", "timeline", "graph", "ipa", "infobox", "navbox", "gallery", "sidebar", "mapframe", "imagemap", "references")
INLINE = ("math", "chem", "ipa", "code")
LIMIT = 50_000


@lru_cache
def _tokens(left: str, right: str) -> re.Pattern:
    return re.compile(f"{re.escape(left)}|{re.escape(right)}")


def nested(text: str, left: str, right: str, make: Callable[[str], str]) -> str:
    """Replaces innermost pairs of brackets, leftmost first, until none is left; a left one that nothing closes
    ends it. One pass with a stack; what `make` returns is scanned again only where it could form brackets."""
    if left not in text:
        return text
    edge, frames, at, done = set(left + right), [[]], 0, 0
    tokens = list(_tokens(left, right).finditer(text))
    for k, t in enumerate(tokens):
        if t[0] == left:
            frames[-1].append(text[at : t.start()])
            frames.append([])
            at = t.end()
        elif len(frames) > 1:
            made = make("".join(frames.pop()) + text[at : t.start()])
            done += 1
            at = t.end()
            before = "".join(frames[-1])
            frames[-1] = [before, made]
            joint = before[-1:] + made + text[at : at + 1]
            if (made and not edge.isdisjoint(made)) or (not made and not edge.isdisjoint(before[-1:]) and not edge.isdisjoint(text[at : at + 1])) or left in joint or right in joint:
                open_ = "".join("".join(f) + left for f in frames[:-1]) + "".join(frames[-1])
                return _again(open_ + text[at:], left, right, make, LIMIT - done)
            if done >= LIMIT:
                break
    out = "".join("".join(f) + left for f in frames[:-1]) + "".join(frames[-1])
    return out + text[at:]


def _again(text: str, left: str, right: str, make: Callable[[str], str], most: int) -> str:
    at = 0
    while most > 0:
        first = text.find(left, at)
        close = text.find(right, first + len(left)) if first >= 0 else -1
        if close < 0:
            return text
        inner = first
        while True:
            following = text.find(left, inner + len(left), close)
            if following < 0:
                break
            inner = following
        text = text[:inner] + make(text[inner + len(left) : close]) + text[close + len(right) :]
        at = max(0, first - len(left) + 1) if inner == first else first
        most -= 1
    return text


def covered(text: str, left: str, right: str, by: str) -> str:
    """nested() for one text `by` that forms no bracket with what stands beside it: outermost pairs are enough."""
    if left not in text:
        return text
    spans, unclosed, done = [], [], 0
    for t in _tokens(left, right).finditer(text):
        if t[0] == left:
            unclosed.append(t.start())
        elif unclosed:
            start = unclosed.pop()
            while spans and spans[-1][0] > start:
                spans.pop()
            spans.append((start, t.end()))
            done += 1
            if done >= LIMIT:
                break
    out, at = [], 0
    for start, end in spans:
        out += [text[at:start], by]
        at = end
    return "".join([*out, text[at:]])


def balanced(text: str, at: int, left: str = "{{", right: str = "}}") -> int:
    """Where the bracket that opens at `at` is closed (behind it), or -1."""
    depth = 0
    for t in _tokens(left, right).finditer(text, at):
        depth += 1 if t[0] == left else -1
        if not depth:
            return t.end()
    return -1


def pieces(text: str) -> list[str]:
    """Parts between | outside of any bracket."""
    out, depth, start = [], 0, 0
    for t in re.finditer(r"[][{}|]", text):
        c = t[0]
        if c in "[{":
            depth += 1
        elif c in "]}":
            depth -= 1
        elif not depth:
            out.append(text[start : t.start()])
            start = t.end()
    return [*out, text[start:]]


# characters

_REF = re.compile(r"&#([xX]?)([0-9a-fA-F]+);")
_NAME = re.compile(r"&([A-Za-z][A-Za-z0-9]*);")


def character(m: re.Match) -> str:
    digits = m[2] if m[1] else re.match(r"[0-9]*", m[2])[0] or "0"
    code = int(digits, 16 if m[1] else 10)
    return chr(code) if 0 < code <= 0x10FFFF and not 0xD800 <= code < 0xE000 else ""


def entities(text: str) -> str:
    """Decodes numeric references, and named ones that end in a semicolon."""
    return _NAME.sub(lambda m: W.ENTITIES.get(m[1], m[0]), _REF.sub(character, text)) if "&" in text else text


# HTML

_COMMENT = re.compile(r"<!--.*?-->", re.S)
_SELF_CLOSED = re.compile(r"<[^<>]+/>")
_BLOCKS = [(f"<{tag}", f"{tag}>") for tag in reversed(W.BLOCK_TAGS)]
_AREA = re.compile(r"^(?:default|circle|poly|rect)\s+[\s\d]+.*$", re.I | re.M)
_AREA_WORDS = ("default", "circle", "poly", "rect")


def without_html(text: str) -> str:
    if "<" in text:
        text = _COMMENT.sub("", text) if "<!--" in text else text
        text = _SELF_CLOSED.sub("", text) if "/>" in text else text
        for left, right in _BLOCKS if "<" in text else ():
            if left in text:
                text = nested(text, left, right, lambda _: "")
    if text.isascii():  # then no letter but its own two forms
        low = text.lower()
        if not any(word in low for word in _AREA_WORDS):
            return text
    return _AREA.sub("", text)


_BR = re.compile(r"<br ?/>", re.I)
_REF_TAGS = ((re.compile(r"<ref[^>]*/>", re.I), ""), (re.compile(r"<ref[^>]*>", re.I), "[ref]"), (re.compile(r"</ref>", re.I), "[/ref]"))


def references(text: str) -> str:
    if "<" not in text:
        return text
    text = _BR.sub("\n", text)
    for pattern, by in _REF_TAGS:
        text = pattern.sub(by, text)
    return text


# links

_CATEGORY_NS = re.compile(rf"\s*(?:{W.any_of(W.CATEGORY)})\s*:", re.I)
_FILE_NS = re.compile(rf"\s*(?:{W.any_of(W.FILE)})\s*:", re.I)
_SIZE = re.compile(r"\d+(?:x\d+)?px|x\d+px", re.I)
_PARAMS = frozenset(x.lower() for x in W.IMAGE_PARAMS)


def pipe_trick(target: str) -> str:
    """What a link shows whose label was left empty."""
    target = re.sub(r"\A[^:]+:", "", target, count=1)
    target = re.sub(r"\s*[(][^)]+[)]\s*\Z", "", target, count=1)
    return re.sub(r"\s*,.*\Z", "", target, count=1).strip()


def _caption(link: str) -> str:
    for part in reversed(link.replace("\n", "|").split("|")[1:]):
        part = part.strip()
        if part and "=" not in part and not _SIZE.fullmatch(part) and part.lower() not in _PARAMS:
            return part
    return ""


def link_text(link: str) -> str:
    target, *labels = link.split("|")
    if _CATEGORY_NS.match(target):
        return ""
    if _FILE_NS.match(target):
        return _caption(link)
    if not labels:
        return target
    return pipe_trick(target) if len(labels) == 1 and not labels[0].strip() else "|".join(labels)


def links(text: str) -> str:
    return nested(text, "[[", "]]", link_text)


def external_text(link: str) -> str:
    if re.match(r"\A\s.+\s\Z", link):
        return f" ({link.strip()}) "
    return (link.split(None, 1) or [""])[-1]


def external_links(text: str) -> str:
    return nested(text, "[", "]", external_text)


# markers

_TAGS = {
    "math": ["math"], "code": ["code"], "codeblock": ["syntaxhighlight", "source", "pre"], "chem": ["chem"], "table": ["table"], "score": ["score"], "timeline": ["timeline"],
    "graph": ["graph"], "gallery": ["gallery"], "mapframe": ["mapframe"], "imagemap": ["imagemap"],
}
_TAG_MARKS = {k: [re.compile(rf"<{t}[^>]*>.*?</{t}>", re.S | re.I) for t in v] for k, v in _TAGS.items()}
_TAG_MARKS["references"] = [re.compile(r"<references\s*/>", re.I), re.compile(r"<references[^>]*>.*?</references>", re.S | re.I)]
_TEMPLATE_MARKS = {
    "math": re.compile(r"\{\{(?:mvar|math)\s*\|", re.I), "chem": re.compile(r"\{\{(?:ce|chem)\s*\|", re.I), "ipa": re.compile(r"\{{2}IPAc?(?:-[a-z][a-z][a-z]?)?\s*\|", re.I),
    "infobox": re.compile(r"\{\{[iI]nfobox"), "navbox": re.compile(r"\{\{[nN]avbox"), "sidebar": re.compile(r"\{\{[sS]idebar"), "references": re.compile(r"\{\{[rR]eflist"),
}
_REF_BEGIN, _REF_END = re.compile(r"\{\{refbegin", re.I), re.compile(r"\{\{refend\s*\}\}", re.I)


_KIND_SIGNS = {kind: f"««{kind.upper()}»»" for kind in MARKERS}
_SHOWN_SIGNS = re.compile(rf"««({'|'.join(MARKERS).upper()})»»")


def _sign(kind: str) -> str:
    return _KIND_SIGNS[kind]


def chosen(markers) -> tuple[str, ...]:
    """Marker kinds of an option: all for True or None, none for False, else those named."""
    return MARKERS if markers is None or markers is True else () if markers is False else tuple(m for m in MARKERS if m in markers)


def _cut_templates(text: str, pattern: re.Pattern, by: str) -> str:
    out, at = [], 0
    while m := pattern.search(text, at):
        end = balanced(text, m.start())
        if end < 0:
            break
        out += [text[at : m.start()], by]
        at = end
    return "".join([*out, text[at:]])


def mark(text: str, on: tuple[str, ...]) -> str:
    if "<" not in text and "{{" not in text:  # neither tags nor templates: tables alone may be marked
        return covered(text, "{|", "|}", _sign("table")) if "table" in on else text
    for kind in MARKERS:
        by = _sign(kind) if kind in on else ""
        for pattern in _TAG_MARKS.get(kind, ()) if "<" in text else ():
            text = pattern.sub(by, text)
        if kind == "table" and by:
            text = covered(text, "{|", "|}", by)
        if kind in _TEMPLATE_MARKS and "{{" in text:
            text = _cut_templates(text, _TEMPLATE_MARKS[kind], by)
        if kind == "references" and by:
            while (a := _REF_BEGIN.search(text)) and (z := _REF_END.search(text, a.start())):
                text = text[: a.start()] + by + text[z.end() :]
    return text


def marks_shown(text: str) -> str:
    return _SHOWN_SIGNS.sub(r"[\1]", text) if "««" in text else text


# templates inside running text

_HEAVY = ("infobox", "efn", "sfn", "unreliable source", "refn", "reflist", "col-list", "column-list", "columns-list", "div col", "no col", "bar box", "formatnum:", "col|", "see also|", "r|", "#")
_ANGLED = re.compile(r"<<([^<>]+)>>\s?")


def _drop_pairs(text: str, left: str, right: str, test: Callable[[str, int, int], bool]) -> str:
    out, at, look = [], 0, 0
    while (a := text.find(left, look)) >= 0:
        end = balanced(text, a, left, right)
        if end > 0 and test(text, a, end):
            out.append(text[at:a])
            at = look = end
        else:
            look = a + len(left)
    return "".join([*out, text[at:]])


def without_complex(text: str) -> str:
    """Drops file links with links inside, links that stand as blocks, and templates that carry no running text."""
    text = _ANGLED.sub(r"《\1》", text)
    if "[[" in text:
        text = _drop_pairs(text, "[[", "]]", lambda t, a, z: t[a + 2 : a + 7].lower() == "file:")
        text = _drop_pairs(text, "[[", "]]", lambda t, a, z: (a == 0 or t[a - 1] == "\n") and t[z - 3] == "\n")
    if "{{" in text:
        text = _drop_pairs(text, "{{", "}}", lambda t, a, z: t[a + 2 : a + 24].lower().startswith(_HEAVY))
        text = _drop_pairs(text, "{{", "}}", lambda t, a, z: bool(re.match(r"[^{}]+?\n\|", t[a + 2 : z - 2])))
    return text


def citation(content: str) -> str:
    """Author, title and year of a citation template, as far as it has them."""
    p = {k.strip().lower(): v.strip() for k, eq, v in (x.partition("=") for x in content.split("|")) if eq}
    author = next((p[k] for k in ("last", "last1", "author", "author1") if k in p), "")
    first = next((p[k] for k in ("first", "first1") if k in p), "")
    year = p.get("year", "") or (p["date"][:4] if re.match(r"\d{4}", p.get("date", "")) else "")
    title = p.get("title", "")
    parts = [f"{author}, {first}" if author and first else author, title and f'"{title}"', year]
    return ". ".join(x for x in parts if x) + "." if any(parts) else ""


def _content(parts: list[str]) -> str:
    if len(parts) == 1:
        return parts[0].strip()
    plain = (x.strip() for x in parts[1:] if "=" not in x)
    named = (x.split("=", 1)[1].strip() for x in parts[1:] if "=" in x)
    return next((x for x in plain if x), None) or next((x for x in named if x), "")


def _split(text: str) -> list[str]:
    parts = text.split("|")
    while parts and not parts[-1]:
        parts.pop()
    return parts


def inline_template(content: str, on: tuple[str, ...], cite: bool) -> str:
    parts = _split(content)
    if not parts:
        return ""
    name = parts[0].strip()
    low = name.lower()
    get = lambda i: parts[i].strip() if i < len(parts) else ""
    if low == "ipa" or low.startswith(("ipa-", "ipac-")):
        return _sign("ipa") if "ipa" in on else get(1)
    if low in ("lang", "fontsize"):
        return get(2) if len(parts) > 2 else get(1)
    if low.startswith("lang-"):
        return get(1)
    if low == "langwithname":
        return get(3) if len(parts) > 3 else parts[-1].strip()
    for kind, names in (("math", ("math", "mvar")), ("chem", ("chem", "ce"))):
        if low in names:
            return _sign(kind) if kind in on else get(1)
    if low in W.CITATIONS:
        return citation(content) if cite else ""
    if low in W.DROPPED or low in W.FLAGS or re.fullmatch(r"[A-Z]{2,3}", name):
        return ""
    if low in W.RUBY:
        return f"{get(1)}（{get(2)}）" if get(2) else get(1)
    if low in W.INTERLANGUAGE:
        return get(1)
    if low in W.SCRIPTS:
        if low.startswith("nihongo"):
            extra = ", ".join(x for x in (get(2), get(3)) if x)
            return f"{get(1)} ({extra})" if extra else get(1)
        return get(2) or get(1) if low in ("transl", "transliteration") else get(1)
    if low in W.CONVERTERS:
        return f"{get(1)} {get(2)}" if get(2) else get(1)
    if low in W.FORMATTING:
        return " " if low == "nbsp" else get(1)
    return _content(parts)


def inline_templates(text: str, on: tuple[str, ...] = MARKERS, cite: bool = False) -> str:
    return nested(text, "{{", "}}", lambda c: inline_template(c, on, cite))


def without_templates(text: str) -> str:
    if "{{" not in text:
        return text
    return nested(nested(text, "{{", "}}", lambda _: ""), "{", "}", lambda _: "")


def without_tables(text: str) -> str:
    return nested(text, "{|", "|}", lambda _: "")


# simple marks

_SWITCH = re.compile(W.any_of(W.SWITCHES), re.I)
_EMPHASIS = re.compile(r"(''+)(.+?)\1")
_DASH = re.compile(r"\{(?:–|ndash|mdash)\}")
_RULE = re.compile(r"^\s*-{4,}\s*$", re.M)
_TAG = re.compile(r"<[^<>]*>")
_REF_MARK = re.compile(r"\[ref\](.*?)\[/ref\]", re.S)
_MARKS = (("__", _SWITCH, ""), ("''", _EMPHASIS, r"\2"), ("{", _DASH, "–"), ("----", _RULE, ""), ("<", _TAG, ""))
_SIGNS = ("[", "{", "<", "''", "__", "----")  # a text without any of them has no markup
_NOWIKI = re.compile(r"<nowiki>(.*?)</nowiki>", re.S)


def plain(text: str, markers=None, cite: bool = False, ref: bool = False, inline: bool = False, table: bool = False) -> str:
    """Wikitext without markup. References go before external links are read, as their brackets look like those."""
    if not any(sign in text for sign in _SIGNS):
        return text
    on = chosen(markers)
    text = without_complex(mark(text, tuple(m for m in on if m != "references") if cite else on))
    kept: list[str] = []

    def keep(m: re.Match) -> str:
        kept.append(m[1])
        return f"<nowiki-{len(kept) - 1}>"

    text = _NOWIKI.sub(keep, text)
    text = _REF_MARK.sub("" if not ref else lambda m: f"«ref»{m[1]}«/ref»", text)
    text = external_links(links(text))
    text = text.replace("«ref»", "[ref]").replace("«/ref»", "[/ref]") if ref else text
    text = re.sub(r"<nowiki-(\d+)>", lambda m: kept[int(m[1])] if int(m[1]) < len(kept) else "", text)
    for has, pattern, by in _MARKS:
        if has in text:
            text = pattern.sub(by, text)
    if not inline:
        text = without_templates(inline_templates(text, on, cite))
    return text if table or "table" in on else without_tables(text)


# what remains after all that

_ALONE = {k: re.compile(rf"^\s*(?:{W.any_of(v)}{more})\s*$", re.I | re.M) for k, v, more in (("remnants", W.REMNANTS, r"|notelist\d+"), ("authority", W.AUTHORITY, ""))}
_STEPS: list[tuple[re.Pattern, str]] = [
    (re.compile(p, f), by)
    for p, f, by in (
        (r"\[ref\]\s*\[/ref\]", 0, ""),
        (r"^File:.+$", re.M, ""),
        (r"^\|.*$", re.M, ""),
        (r"\{\{.*$", re.M, ""),
        (r"^.*\}\}", re.M, ""),
        (r"\{\|.*$", re.M, ""),
        (r"^.*\|\}", re.M, ""),
        (r"\n{3,}", 0, "\n\n"),
        (r"\n(?:[\t ]*\n){2,}", 0, "\n\n"),
        (r"(?<=[^\n]) {2,}", 0, " "),
        (r"（\s*）|\(\s*\)", 0, ""),
        (r"\|{2,}", 0, ""),
        (r"\|\s*$", re.M, ""),
        (r"^[^\S\n]*\|[^|\n]*$\n?", re.M, ""),
        (r"^[^\S\n]*\|?(?:\w+=[-\s\w]+\|)+\w+=[-\s\w]+[^\S\n]*$", re.M, ""),
        (_ALONE["remnants"].pattern, re.I | re.M, ""),
        (rf"^(?:{W.any_of(W.FILE)}):.+\|.+$", re.I | re.M, ""),
        (rf"\[\[(?:{W.any_of(W.FILE)}):[^\]]*\|?\s*$", re.I | re.M, ""),
        (r"(?:(?<=\s)|^)([^\n\[\]|]+)\]\]", re.M, r"\1"),
        (r"\[{2}[^][\n]*$|^\s*\]{2}\s*$", re.M, ""),
        (r"(?<=[^\n\[\]|])\|([^\n\[\]|]+)\]\](?!\])", 0, r"\1"),
        (rf"\{{\{{\s*(?:{W.any_of(W.SORT_WORDS)})[^}}]*\}}\}}", re.I, ""),
        (rf"^(?:{W.any_of(W.SORT_WORDS)})[^\n]*$", re.I | re.M, ""),
        (_SWITCH.pattern, re.I, ""),
        (r":[a-z]{2,3}:(?=[^\s\]])", 0, ""),
        (_ALONE["authority"].pattern, re.I | re.M, ""),
        (rf"^\s*(?:\*\s*)?(?!CATEGORIES)(?:{W.any_of(W.CATEGORY)}):[^\n]+$", re.I | re.M, ""),
        (rf"^\s*(?:{W.any_of(W.PROJECTS)}|Wikimedia\s*Commons|Commons\s*cat(?:egory)?)(?::|$)", re.I | re.M, ""),
        (r"^\s*\*\s*$", re.M, ""),
        (r"\n{3,}", 0, "\n\n"),
    )
]


#: What a text must hold for each step to find anything.
_NEEDED = (
    "[ref]", "File:", "|", "{{", "}}", "{|", "|}", "\n\n\n", "\n", "  ", "", "||", "|", "|", "=", "", "|", "[[", "]]", "", "]]", "{{", "", "__", ":", "", ":", "", "*", "\n\n\n",
)


_MARKUP = re.compile(r"[][{}|=:*_()]|\n[\t ]*\n|  ")
#: Beginnings of the lines that a step drops by their words alone.
_WORDY = frozenset(x.lower()[:4] for x in W.REMNANTS | W.AUTHORITY | W.SORT_WORDS | W.PROJECTS | {"wikimedia", "commons", "notelist"})


def _tame(text: str) -> bool:
    """Whether no step can find anything: neither signs, nor folding white space, nor words that stand alone."""
    return text.isascii() and not _MARKUP.search(text) and not any(line.strip()[:4] in _WORDY for line in text.lower().split("\n"))


def cleaned(text: str) -> str:
    """Removes remnants of markup and folds white space; ends in an empty line."""
    if _tame(text):
        return text.strip() + "\n\n"
    for (pattern, by), has in zip(_STEPS, _NEEDED, strict=True):
        if has in text:
            text = pattern.sub(by, text)
    return text.strip() + "\n\n"
