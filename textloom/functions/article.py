"""Articles: wikitext to typed elements, sections and formatted output; plain Python, one article at a time."""

from __future__ import annotations

import datetime as dt
import json
import re
from dataclasses import dataclass, field
from functools import lru_cache

from textloom.functions import scan, templates
from textloom.functions import words as W

CATEGORY = re.compile(rf"[{{\[|\x08](?:{W.any_of(W.CATEGORY)})\s*:([^|\]}}]+)[|\]}}]", re.I)
REDIRECT = re.compile(rf"[#＃](?:{W.any_of(W.REDIRECT)})\s*(?::\s*)?\[{{2}}([^]]+)\]{{2}}", re.I)
_HEADING = re.compile(r"^=+.*?=+\s*$")
_MULTI = {"mw_inputbox": r"</inputbox>", "mw_source": r"</source>", "mw_math": r"</math>", "mw_htable": r"</\s*table>", "mw_table": r"^\|\}"}
_ENDS = {k: re.compile(v) for k, v in _MULTI.items()}
_LIST, _DEFINITION = re.compile(r"\A[ :;#*]+"), re.compile(r"\A[ :;]+")
#: (type, what the line must hold, test, whether it opens a block), in order; a line of white space is none of them.
_KINDS = [
    ("mw_isolated_template", "{{", re.compile(r"\A\s*\{{2}.+\}{2}\s*\Z"), False),
    ("mw_isolated_tag", "<", re.compile(r"^\s*<[^<>]+>.+<[^<>]+>\s*$"), False),
    ("mw_redirect", "[[", REDIRECT, False),
    ("mw_heading", "=", _HEADING, False),
    ("mw_inputbox", "<", re.compile(r"<inputbox>.*?</inputbox>"), False),
    ("mw_ml_template", "{{", re.compile(r"^\{\{[^}]*$"), True),
    ("mw_ml_link", "[[", re.compile(r"\A\[{2}(?!.*\]{2}\s*\Z)"), True),
    ("mw_inputbox", "<", re.compile(r"<inputbox>"), True),
    ("mw_source", "<", re.compile(r"<source.*?>.*?</source>"), False),
    ("mw_source", "<", re.compile(r"<source.*?>"), True),
    ("mw_math", "<", re.compile(r"<math.*?>.*?</math>"), False),
    ("mw_math", "<", re.compile(r"<math.*?>"), True),
    ("mw_htable", "<", re.compile(r"<table.*?></table>"), False),
    ("mw_htable", "<", re.compile(r"<table\b"), True),
    ("mw_table", "{|", re.compile(r"^\s*\{\|"), True),
    ("mw_unordered", "*", re.compile(r"^\*"), False),
    ("mw_ordered", "#", re.compile(r"^#"), False),
    ("mw_pre", " ", re.compile(r"^ "), False),
    ("mw_definition", "", re.compile(r"^[:;]"), False),
    ("mw_link", "[", re.compile(r"^\s*\[.*\]\s*$"), False),
]


_CELL_GAP = re.compile(r"\|\n\n+")


def prepared(text: str) -> str:
    """Characters decoded, HTML blocks gone, references marked: what the line parser reads."""
    text = scan.entities(text)
    return scan.references(scan.without_html(_CELL_GAP.sub("|\n", text) if "|\n\n" in text else text))


def categories(text: str) -> list[str]:
    """Names as written, without sort keys, in order of first occurrence."""
    return list(dict.fromkeys(m for line in text.split("\n") for m in CATEGORY.findall(line + "\n")))


def heading_level(line: str) -> int:
    return len(line) - len(line.lstrip("=")) or 2


def _tight(heading: str) -> str:
    """A heading without white space inside its signs."""
    level = len(heading) - len(heading.lstrip("="))
    heading = heading[:level] + heading[level:].lstrip()
    body = heading.rstrip("=")
    return body.rstrip() + heading[len(body) :] if len(body) < len(heading) else heading


#: Beginnings of lines that may be other than a paragraph; others are only if they hold one of the signs.
_BRACES = re.compile(r"\{\{|\}\}")
_LINE = re.compile(r"[^\n]*\n|[^\n]+\Z")
_BEGINS, _SIGNS = frozenset("{[=*#:;<＃"), re.compile("[<#＃]")


def parse(text: str, strip_marks: bool = False, ready: str | None = None) -> list[tuple[str, str, int | None]]:
    """(type, text, level) of every element; only headings have a level. `ready` is prepared(text), if it is known."""
    out: list[list] = []
    mode, depth = "", 0
    for line in _LINE.findall(prepared(text) if ready is None else ready):
        if mode == "mw_ml_template":
            end, depth = _closing(line, depth)
            out[-1][1] += line if end < 0 else line[:end]
            if end >= 0:
                mode = ""
                if line[end:].strip():
                    out.append(["mw_paragraph", "\n" + line[end:], None])
            continue
        if mode:
            out[-1][1] += line
            over = re.search(r"\]\]\s*$", scan.nested(line, "[[", "]]", lambda _: "")) if mode == "mw_ml_link" else _ENDS[mode].search(line)
            mode = "" if over else mode
            continue
        bare = line[:-1] if line.endswith("\n") else line
        if bare and bare[0] not in _BEGINS and not bare[0].isspace() and not _SIGNS.search(bare):
            out.append(["mw_paragraph", "\n" + line, None])
            continue
        kind, opens = "mw_paragraph", False
        if not bare or bare.isspace():
            kind = "mw_blank"
        else:
            for k, has, test, o in _KINDS:
                if has in bare and test.search(bare):
                    kind, opens = k, o
                    break
        if kind == "mw_ml_link" and line.count("[[") <= line.count("]]"):
            kind, opens = "mw_paragraph", False
        if kind == "mw_ml_template":
            depth = line.count("{{") - line.count("}}")
        mode = kind if opens else ""
        if kind == "mw_heading":
            out.append([kind, f"\n{_tight(bare)}\n\n" if line.endswith("\n") else f"\n{_tight(bare)}\n", heading_level(line)])
        elif kind == "mw_blank":
            out.append([kind, "\n", None])
        elif kind == "mw_paragraph":
            out.append([kind, "\n" + line, None])
        else:
            if strip_marks and kind in ("mw_unordered", "mw_ordered"):
                line = _LIST.sub("", line)
            elif strip_marks and kind == "mw_definition":
                line = _DEFINITION.sub("", line)
            out.append([kind, line, None])
    return [tuple(e) for e in out]


def _closing(line: str, depth: int) -> tuple[int, int]:
    """(where the template that is `depth` deep ends in line, or -1; its depth after it)."""
    for t in _BRACES.finditer(line):
        depth += 1 if t[0] == "{{" else -1
        if not depth:
            return t.end(), 0
    return -1, depth


# output


@dataclass(frozen=True)
class Options:
    """What is put out, and how; the defaults are those of full-text extraction."""

    format: str = "text"
    mode: str = "full"  # full, category, summary, metadata, sections
    title: bool = True
    heading: bool = True
    list: bool = False
    table: bool = False
    pre: bool = False
    ref: bool = False
    redirect: bool = False
    multiline: bool = False
    category: bool = True
    markers: bool | tuple[str, ...] = True
    extract_citations: bool = False
    expand_templates: bool = True
    inline_math: bool = True
    sections: tuple[str, ...] = ()
    section_output: str = "structured"
    min_section_length: int = 0
    skip_empty: bool = False
    section_aliases: bool = True
    aliases: tuple[tuple[str, tuple[str, ...]], ...] = field(default=())
    show_matched_sections: bool = False
    reference: dt.datetime = templates.REFERENCE


#: Templates that markers, citations or inline rules turn into text keep until those see them.
_LATER = re.compile(rf"\{{\{{\s*(?:infobox|navbox|sidebar|reflist|refbegin|refend|math|mvar|chem|ce|ipa\w*(?:-\w+)?|{W.any_of(W.CITATIONS)}|{W.any_of(W.RUBY | W.INTERLANGUAGE)})\s*[|}}\n]", re.I)


def plain(text: str, o: Options = Options(), title: str | None = None) -> str:  # noqa: B008
    """Wikitext as text: magic words, parser functions, templates, markers, links and marks, entities."""
    if title and "{{" in text:
        text = templates.magic(text, title, now=o.reference)
    if o.expand_templates and "{{" in text:
        text = templates.evaluate(text, o.reference)
        keep = {}
        if _LATER.search(text):
            text = _held(text, keep)
        text = templates.expand_templates(text, o.reference)
        text = re.sub("\x01(\\d+)\x02", lambda m: keep[int(m[1])], text)
    text = scan.plain(text, o.markers, o.extract_citations, o.ref, table=o.table)
    return scan.marks_shown(scan.entities(text))


def _held(text: str, keep: dict[int, str]) -> str:
    out, at = [], 0
    while m := _LATER.search(text, at):
        end = scan.balanced(text, m.start())
        if end < 0:
            break
        keep[len(keep)] = text[m.start() : end]
        out += [text[at : m.start()], f"\x01{len(keep) - 1}\x02"]
        at = end
    return "".join([*out, text[at:]])


def _shown(kind: str, text: str, o: Options, title: str | None) -> str:
    if kind in ("mw_heading", "mw_paragraph"):
        return plain(text, o, title) + "\n" if kind != "mw_heading" or o.heading else ""
    if kind == "mw_math" and o.inline_math:
        return plain("\n" + text, o, title) + "\n"
    if kind in ("mw_link", "mw_ml_link"):
        text = plain(text, o, title)
        return text + "\n" if text.strip() else ""
    if kind == "mw_redirect":
        return text + "\n\n" if o.redirect else ""
    wanted = {
        "mw_table": o.table, "mw_htable": o.table, "mw_pre": o.pre, "mw_unordered": o.list, "mw_ordered": o.list, "mw_definition": o.list, "mw_ml_template": o.multiline, "mw_isolated_template": o.multiline,
    }
    return text + "\n" if wanted.get(kind) else ""


def body(elements, o: Options = Options(), title: str | None = None) -> str:  # noqa: B008
    return scan.cleaned("".join(_shown(kind, text, o, title) for kind, text, _ in elements))


def redirect(elements) -> str | None:
    return next((m[1] for kind, text, _ in elements if kind == "mw_redirect" and (m := REDIRECT.search(text))), None)


def heading_text(text: str) -> str:
    text = text.strip()
    if text.startswith("="):
        text = text.lstrip("=").lstrip()
    return text.rstrip("=").rstrip()


def headings(elements) -> list[tuple[str, int]]:
    return [(name, level or 2) for kind, text, level in elements if kind == "mw_heading" and (name := heading_text(text))]


def summary(elements) -> str | None:
    parts = []
    for kind, text, _ in elements:
        if kind == "mw_heading":
            break
        if kind not in ("mw_blank", "mw_redirect"):
            parts.append(text)
    return "".join(parts).strip() or None


def alias_groups(o: Options) -> list[set[str]]:
    if not o.section_aliases:
        return []
    return [{x.lower() for x in (k, *v)} for k, v in (W.SECTION_GROUPS | dict(o.aliases)).items()]


@lru_cache
def _targets(o: Options) -> dict[str, str]:
    """Each heading, lowered, that a target answers to, and the target as the user wrote it: by name, else by a group of aliases."""
    found: dict[str, str] = {}
    for t in o.sections:
        found.setdefault(t.lower(), t)
    groups = alias_groups(o)
    for low, t in [(x, t) for t in o.sections for g in groups if t.lower() in g for x in g]:
        found.setdefault(low, t)
    return {low: t for low, t in found.items() if low}


def wanted(heading: str, o: Options) -> str | None:
    return _targets(o).get(heading.lower().strip())


def sections(elements, o: Options) -> tuple[dict[str, str | None], dict[str, str]]:
    """(text of each target or None, actual headings where they differ). A section lasts until a heading of its
    level or above, or one that is a target itself; of a repeated one the last counts."""
    answers = _targets(o)
    found: dict[str, str | None] = dict.fromkeys(o.sections)
    matched: dict[str, str] = {}
    size = lambda x: None if x is None or len(x) < o.min_section_length else x
    if "summary" in found:
        found["summary"] = size(summary(elements))
    now, level, parts = None, None, []
    for kind, text, deep in [*elements, ("mw_heading", "", 0)]:
        if kind != "mw_heading":
            if now:
                parts.append(text)
            continue
        if now:
            found[now] = size("".join(parts).strip())
        name = heading_text(text)
        target = answers.get(name.lower().strip())
        if target and target != "summary":
            if target != name:
                matched[target] = name
            now, level, parts = target, deep or 2, []
        elif level is not None and (deep is None or deep <= level):
            now, level, parts = None, None, []
    return found, matched


def has_sections(elements, o: Options) -> bool:
    return not o.sections or ("summary" in o.sections and summary(elements) is not None) or any(wanted(h, o) for h, _ in headings(elements))


def _json(record: dict) -> str:
    return json.dumps(record, ensure_ascii=False, separators=(",", ":"))


def render(title: str, text: str, o: Options = Options()) -> str | None:  # noqa: B008
    """An article in the mode and format of the options; None if it is to be skipped."""
    ready = prepared(text)
    elements, cats = parse(text, ready=ready), categories(ready)
    shown = plain(title.strip(), o)
    as_json = o.format == "json"
    if o.mode == "metadata":
        names = [h for h, _ in headings(elements)]
        return _json({"title": shown, "sections": names, "categories": cats}) if as_json else f"{shown}\t{'|'.join(names)}\t{','.join(cats)}\n"
    if o.mode in ("summary", "sections"):
        return _sections_out(shown, title, elements, cats, o)
    if as_json:
        record = {"title": shown, "categories": cats if o.category else None, "text": None if o.mode == "category" else body(elements, o, title).strip(), "redirect": redirect(elements)}
        return _json(record)
    if o.mode == "category":
        return f"{shown}\t{', '.join(cats)}\n"
    out = body(elements, o, title) + (f"\nCATEGORIES: {', '.join(cats)}\n\n" if o.category and cats else "")
    return f"\n[[{shown}]]\n\n{out}" if o.title else out


def _sections_out(shown: str, title: str, elements, cats: list[str], o: Options) -> str | None:
    if o.mode == "summary":
        o = Options(**(o.__dict__ | {"sections": ("summary",), "section_output": "combined", "mode": "sections"}))
    if o.skip_empty and not has_sections(elements, o):
        return None
    found, matched = sections(elements, o)
    found = {k: None if v is None else scan.cleaned(plain(v, o, title)) for k, v in found.items()}
    full = [k for k, v in found.items() if v]
    together = "\n\n".join(found[k] for k in full)
    if o.format == "json":
        record = {"title": shown} | ({"text": together, "sections_included": full} if o.section_output == "combined" else {"sections": found})
        record |= {"categories": cats} if o.category else {}
        return _json(record | ({"matched_sections": matched} if o.show_matched_sections and matched else {}))
    if o.section_output == "combined":
        out = f"TITLE: {shown}\nSECTIONS: {', '.join(full)}\n\n{together}\n\n"
    else:
        out = f"TITLE: {shown}\n\n" + "".join(f"SECTION [{k}]: (not found)\n\n" if v is None else f"SECTION [{k}]:\n{v}\n\n" for k, v in found.items())
    return out + (f"CATEGORIES: {', '.join(cats)}\n" if o.category and cats else "") + "\n"
