"""Settings that are kept in a file, section aliases from a file, and the rules that options have to meet."""

from __future__ import annotations

import re
from dataclasses import asdict, dataclass, fields
from pathlib import Path
from typing import Any

from textloom.functions.article import Options

FORMATS = ("text", "json")
MODES = ("full", "category", "summary", "metadata", "sections", "section-stats")
LANGUAGE = re.compile(r"[a-z]{2,10}(?:-[a-z]{2,10})?")
#: Least and largest value of each number.
RANGES = {"dump_expiry_days": (1, 365), "category_expiry_days": (1, 90), "default_depth": (0, 10)}


class OptionError(ValueError):
    """Options that don't go together, or are out of range."""


@dataclass(frozen=True)
class Settings:
    """What holds unless a call says otherwise; numbers out of range become the nearest one in it, unknown formats text."""

    dump_expiry_days: int = 30
    category_expiry_days: int = 7
    cache_directory: str = "~/.textloom/cache"
    default_format: str = "text"
    default_depth: int = 0

    def __post_init__(self) -> None:
        for name, (least, most) in RANGES.items():
            object.__setattr__(self, name, min(max(_number(getattr(self, name)), least), most))
        if self.default_format not in FORMATS:
            object.__setattr__(self, "default_format", FORMATS[0])
        if not str(self.cache_directory or ""):
            object.__setattr__(self, "cache_directory", Settings.__dataclass_fields__["cache_directory"].default)

    @classmethod
    def load(cls, path: str | Path) -> Settings:
        """From a file of `name: value` lines, below headings or not; without a readable file, the defaults."""
        try:
            found = mapping(Path(path).expanduser().read_text("utf-8"))
        except (OSError, ValueError):
            return cls()
        flat = dict(found)
        for value in found.values():
            flat |= value if isinstance(value, dict) else {}
        flat |= {f"default_{k}": flat[k] for k in ("format", "depth") if k in flat} | ({"cache_directory": flat["directory"]} if "directory" in flat else {})
        return cls(**{f.name: flat[f.name] for f in fields(cls) if f.name in flat})

    def save(self, path: str | Path, force: bool = True) -> bool:
        """Writes the file; an existing one only if forced. Whether it was written."""
        at = Path(path).expanduser()
        if at.exists() and not force:
            return False
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text("".join(f"{k}: {v}\n" for k, v in asdict(self).items()), "utf-8")
        return True


def _number(x: Any) -> int:
    m = re.match(r"\s*[+-]?\d+", str(x))
    return int(m[0]) if m else 0


def _scalar(x: str) -> str:
    x = x.strip()
    return x[1:-1] if len(x) > 1 and x[0] == x[-1] and x[0] in "'\"" else re.sub(r"\s+#.*\Z", "", x)


def mapping(text: str) -> dict[str, Any]:
    """A mapping in the plain part of YAML: `key: value`, `key: [a, b]`, and `- item` or `name: value` lines that are
    indented below their key. ValueError for other lines."""
    out: dict[str, Any] = {}
    key = None
    for line in text.splitlines():
        if not line.strip() or line.lstrip().startswith(("#", "---")):
            continue
        inner = line[0] in " \t" or (line.startswith("-") and key is not None)
        item = re.fullmatch(r"\s*-\s+(.*)", line)
        pair = re.fullmatch(r"\s*(\"[^\"]*\"|'[^']*'|[^:#]+?)\s*:(?:\s+(.*))?", line)
        if item and inner and key is not None:
            out[key] = [*(out[key] if isinstance(out[key], list) else []), _scalar(item[1])]
        elif pair and inner and key is not None and not isinstance(out[key], list):
            out[key] = (out[key] if isinstance(out[key], dict) else {}) | {_scalar(pair[1]).lstrip(":"): _scalar(pair[2] or "")}
        elif pair and not inner:
            key, value = _scalar(pair[1]).lstrip(":"), (pair[2] or "").strip()
            many = re.fullmatch(r"\[(.*)\]", value)
            out[key] = [_scalar(x) for x in many[1].split(",") if x.strip()] if many else _scalar(value) if value else None
        else:
            raise ValueError(f"not a mapping: {line!r}")
    return out


def aliases(path: str | Path | None) -> tuple[tuple[str, tuple[str, ...]], ...]:
    """Section aliases of a file of `name: [alias, ...]`, as Options takes them; none if it is missing or malformed."""
    try:
        found = mapping(Path(path).expanduser().read_text("utf-8")) if path else {}
    except (OSError, ValueError):
        return ()
    return tuple((k, tuple(v) if isinstance(v, list) else (v,) if isinstance(v, str) else ()) for k, v in found.items() if not isinstance(v, dict))


def valid_language(code: str | None) -> bool:
    return bool(code and LANGUAGE.fullmatch(code))


def titles(text: str | None) -> list[str]:
    """Titles of a list parted by commas, without blanks."""
    return [x.strip() for x in (text or "").split(",") if x.strip()]


def validated(
    options: Options = Options(),  # noqa: B008
    *,
    source: str | None = None,
    lang: str | None = None,
    articles: str | None = None,
    from_category: str | None = None,
    depth: int = 0,
    dry_run: bool = False,
    yes: bool = False,
    file_size: int = 10,
    modes: tuple[str, ...] = (),
) -> Options:
    """The options, if they go together; OptionError says what doesn't. `modes` are the extraction modes asked for."""
    asked = tuple(dict.fromkeys(modes or ((options.mode,) if options.mode != "full" else ())))
    wants_sections = bool(options.sections) or "sections" in asked
    exclusive = [m for m in asked if m in ("category", "summary", "metadata")]
    rules = [
        (source is None and lang is None, "either a source or a language is needed"),
        (source is not None and lang is not None, "a source and a language exclude each other"),
        (bool(articles) and lang is None, "articles by title need a language"),
        (bool(from_category) and lang is None, "articles by category need a language"),
        (bool(articles) and bool(from_category), "titles and a category exclude each other"),
        (depth < 0, "depth must be 0 or more"),
        (dry_run and not from_category, "a dry run needs a category"),
        (yes and not from_category, "a confirmation needs a category"),
        (lang is not None and not valid_language(lang), f"no language code: {lang!r}"),
        (options.format not in FORMATS, f"format must be one of {FORMATS}"),
        (file_size < 0, "file size must be 0 or more"),
        (any(m not in MODES for m in asked), f"modes are {MODES}"),
        (len(exclusive) > 1, f"{' and '.join(exclusive)} exclude each other"),
        (wants_sections and bool(exclusive), f"sections and {exclusive[:1]} exclude each other"),
        ("section-stats" in asked and (wants_sections or bool(exclusive)), "section statistics stand alone"),
        (options.show_matched_sections and options.format != "json", "matched sections need JSON"),
    ]
    for wrong, why in rules:
        if wrong:
            raise OptionError(why)
    return options
