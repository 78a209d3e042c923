"""Expansion of common templates, parser functions and magic words: plain Python, one text at a time."""

from __future__ import annotations

import datetime as dt
import re
import urllib.parse
from collections.abc import Callable
from decimal import ROUND_HALF_UP, Decimal

from textloom.functions import words as W
from textloom.functions.scan import balanced, pieces

PASSES = 10
#: What dates are relative to unless the caller names another: never the clock, so that results repeat.
REFERENCE = dt.datetime(2024, 6, 15, 14, 30, 45)


def number(text: str | None) -> int:
    """The leading integer of a text, else 0."""
    m = re.match(r"\s*([+-]?\d+)", text or "")
    return int(m[1]) if m else 0


def decimal(text: str | None) -> float:
    m = re.match(r"\s*([+-]?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)", text or "")
    return float(m[1]) if m else 0.0


def outermost(text: str, opening: str, make: Callable[[str], str]) -> str:
    """Replaces every outermost {{...}} that begins with `opening`, again and again, up to PASSES times."""
    for _ in range(PASSES):
        if opening not in text:
            break
        out, at = [], 0
        while (a := text.find(opening, at)) >= 0:
            end = balanced(text, a)
            if end < 0:
                break
            out += [text[at:a], make(text[a + 2 : end - 2])]
            at = end
        new = "".join([*out, text[at:]])
        if new == text:
            break
        text = new
    return text


# dates


def day_of(year: int, month: int, day: int) -> dt.date | None:
    """A date, where days beyond the month's end run into the next month."""
    month, day = (month if 1 <= month <= 12 else 1), (day if 1 <= day <= 31 else 1)
    try:
        return dt.date(year, month, 1) + dt.timedelta(days=day - 1)
    except (ValueError, OverflowError):
        return None


def years_between(born: dt.date, then: dt.date) -> int:
    return then.year - born.year - ((then.month, then.day) < (born.month, born.day))


def written_date(year: int, month: int, day: int, day_first: bool = False) -> str:
    if not 1 <= month <= 12:
        return str(year)
    name = W.MONTHS[month - 1]
    if day <= 0:
        return f"{name} {year}"
    return f"{day} {name} {year}" if day_first else f"{name} {day}, {year}"


def rounded(value: float, digits: int = 0) -> Decimal:
    """Half away from zero, of the decimal that the float is written as."""
    return Decimal(repr(value)).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP)


def shown(value: float) -> str:
    r = rounded(value, 1)
    return str(int(r)) if r == int(r) else f"{r:.1f}"


class Parameters:
    """Positional and named parameters of a template."""

    def __init__(self, parts: list[str]):
        self.at: list[str] = []
        self.named: dict[str, str] = {}
        for part in parts:
            key, eq, value = part.partition("=")
            if eq and re.fullmatch(r"[\w\s]+", key.strip()):
                self.named[key.strip().lower()] = value.strip()
            else:
                self.at.append(part.strip())

    def __len__(self) -> int:
        return len(self.at)

    def get(self, i: int, default: str = "") -> str:
        return self.at[i] if i < len(self.at) else default

    def date(self, start: int = 0) -> tuple[int, int, int]:
        return tuple(number(self.get(i)) for i in range(start, start + 3))

    @property
    def day_first(self) -> bool:
        return self.named.get("df") in ("y", "yes")


def _dated(p: Parameters, now: dt.date) -> str:
    return written_date(*p.date(), p.day_first)


def _dated_age(p: Parameters, now: dt.date) -> str:
    return f"{_dated(p, now)} (age {_age(p, now)})"


def _age(p: Parameters, now: dt.date) -> str:
    y, m, d = p.date()
    born = day_of(y, m, d) if 0 < y <= 9999 else None
    return "" if born is None else str(years_between(born, now))


def _two(p: Parameters) -> tuple[dt.date, dt.date] | None:
    if len(p) < 6:
        return None
    a, b = day_of(*p.date(0)), day_of(*p.date(3))
    return (a, b) if a and b else None


def _died(p: Parameters, now: dt.date) -> str:
    if not (two := _two(p)):
        return ""
    y, m, d = p.date()
    text = written_date(y, m if 1 <= m <= 12 else 1, d if 1 <= d <= 31 else 1, p.day_first)
    return f"{text} (aged {years_between(two[1], two[0])})"


def _years(p: Parameters, now: dt.date) -> str:
    return str(years_between(*two)) if (two := _two(p)) else ""


def _days(p: Parameters, now: dt.date) -> str:
    return str((two[1] - two[0]).days) if (two := _two(p)) else ""


def _years_days(p: Parameters, now: dt.date) -> str:
    if not (two := _two(p)):
        return ""
    born, then = two
    last = day_of(then.year, born.month, born.day)
    if last > then:
        last = day_of(then.year - 1, born.month, born.day)
    return f"{years_between(born, then)} years, {(then - last).days} days"


def _ago(p: Parameters, now: dt.date) -> str:
    then = day_of(*p.date())
    if then is None:
        return ""
    days = (now - then).days
    if days < 30:
        return f"{days} days ago"
    return f"{rounded(days / 30)} months ago" if days < 365 else f"{rounded(days / 365)} years ago"


# units and other texts


def _convert(p: Parameters, now: dt.date) -> str:
    value, a, b = decimal(p.get(0)), re.sub(r"\s+", "", p.get(1)), re.sub(r"\s+", "", p.get(2))
    if not p.get(2):
        return f"{shown(value)} {p.get(1)}"
    units = tuple(x.removeprefix("°") if x in ("°C", "°F") else x for x in (a, b))
    if units == ("C", "F"):
        other = str(rounded(value * 9 / 5 + 32))
    elif units == ("F", "C"):
        other = str(rounded((value - 32) * 5 / 9))
    elif (a, b) in W.FACTORS:
        other = shown(value * W.FACTORS[a, b])
    else:
        return f"{shown(value)} {W.SYMBOLS.get(a, a if a in _UNITS else p.get(1))}"
    return f"{shown(value)} {W.SYMBOLS.get(a, a)} ({other} {W.SYMBOLS.get(b, b)})"


_UNITS = {u for pair in W.FACTORS for u in pair}


def _span(before: str, least: int = 1):
    def f(p: Parameters, now: dt.date) -> str:
        if len(p) < least:
            return ""
        return f"{before}{p.get(0)}–{p.get(1)}" if len(p) > 1 else f"{before}{p.get(0)}"

    return f


def _circa(p: Parameters, now: dt.date) -> str:
    return " – ".join(f"c. {x}" for x in p.at[:2])


def _married(p: Parameters, now: dt.date) -> str:
    if not p.get(2):
        return f"{p.get(0)} (m. {p.get(1)})" if len(p) > 1 else p.get(0)
    ended = {"widowed": "wid.", "wid": "wid.", "died": "d.", "d": "d."}.get(p.named.get("reason", "").lower(), "div.")
    return f"{p.get(0)} (m. {p.get(1)}; {ended} {p.get(2)})"


def _coord(p: Parameters, now: dt.date) -> str:
    a = p.at
    if len(a) == 2:
        return f"{a[0]}°, {a[1]}°"
    if len(a) == 4:
        ok = re.search("[NS]", a[1], re.I) and re.search("[EW]", a[3], re.I)
        return f"{a[0]}° {a[1].upper()}, {a[2]}° {a[3].upper()}" if ok else ", ".join(a)
    if len(a) == 6:
        return f"{a[0]}°{a[1]}′ {a[2].upper()}, {a[3]}°{a[4]}′ {a[5].upper()}"
    if len(a) == 8:
        return f"{a[0]}°{a[1]}′{a[2]}″ {a[3].upper()}, {a[4]}°{a[5]}′{a[6]}″ {a[7].upper()}"
    return ", ".join(x for x in a if not re.search("name|type|format|display", x, re.I))


def _literally(text: str, p: Parameters) -> str:
    return f"{text} (lit. '{p.named['lit']}')" if "lit" in p.named else text


def _lang(p: Parameters, now: dt.date) -> str:
    return _literally(p.get(1), p) if len(p) > 1 else ""


def _nihongo(p: Parameters, now: dt.date) -> str:
    kanji, romaji = p.get(1), p.get(2)
    inside = f"{kanji}, {romaji}" if kanji and romaji else kanji
    return f"{p.get(0)} ({inside})" if inside else p.get(0)


def _quoted(p: Parameters, now: dt.date) -> str:
    text, source = p.named.get("text", p.named.get("1", p.get(0))), p.named.get("source", p.named.get("2", p.get(1)))
    return text.strip() + (f" — {source}" if source else "")


def _fraction(p: Parameters, now: dt.date) -> str:
    if len(p) == 1:
        return f"1/{p.get(0)}"
    return f"{p.get(0)}+{p.get(1)}/{p.get(2)}" if len(p) == 3 else "/".join(p.at)


def _as_of(p: Parameters, now: dt.date) -> str:
    month = W.MONTHS[(number(p.get(1)) - 1) % 12] if len(p) > 1 else ""
    if len(p) > 2:
        return f"As of {month} {p.get(2)}, {p.get(0)}"
    return f"As of {month} {p.get(0)}" if month else f"As of {p.get(0)}"


def _first(p: Parameters, now: dt.date) -> str:
    return p.get(0)


#: Template names by what expands them; those of `_BARE` also without parameters.
_KINDS: list[tuple[str, Callable[[Parameters, dt.date], str]]] = [
    ("end date/enddate/start date/startdate/death date/deathdate/birth date/birthdate", _dated),
    ("date", lambda p, now: written_date(*p.date())),
    ("birthdate and age/birth date and age", _dated_age),
    ("deathdate and age/death date and age", _died),
    ("death year and age/birth year and age/age", _age),
    ("age in years", _years), ("age in days", _days), ("age in years and days", _years_days), ("time ago", _ago),
    ("cvt/convert", _convert), ("c./circa", _circa), ("fl./floruit", _span("fl. ")), ("r./reign", _span("r. ", 2)), ("played years", _span("", 2)),
    ("married/marriage", _married), ("coordinates/coordinate/coord", _coord), ("lang", _lang), ("transl", lambda p, now: p.get(1, p.get(0))), ("nihongo", _nihongo),
    ("sup/sub/abbrlink/abbr/strong/bold/em/smaller/small/nobr/nowrap", _first), ("quotation/cquote/quote/blockquote", _quoted),
    ("sfrac/fraction/frac", _fraction), ("wiktionary/wikt", lambda p, now: p.get(1, p.get(0))), ("sic", lambda p, now: "[sic]"), ("as of", _as_of),
]
_EXPAND = {name: f for names, f in _KINDS for name in names.split("/")}
_BARE = {"sic", "quotation", "cquote", "quote", "blockquote"}


def template(content: str, now: dt.date = REFERENCE.date(), keep: bool = False) -> str:
    """One template's text; '' for an unknown one, or itself if `keep`."""
    name, *rest = pieces(content)
    name = name.strip().lower()
    p = Parameters(rest if not rest or rest[-1] else rest[:-1])
    if f := _EXPAND.get(name):
        return f(p, now) if len(p) or name in _BARE else ""
    if name.startswith("lang-"):
        code = name[5:]
        return f"{W.LANGUAGES.get(code, code.upper())}: {_literally(p.get(0), p)}" if len(p) else ""
    return f"{{{{{content}}}}}" if keep else ""


def expand_templates(text: str, now: dt.datetime = REFERENCE, keep: bool = False) -> str:
    return outermost(text, "{{", lambda c: template(c, now.date(), keep))


# expressions

_TOKEN = re.compile(r"\s*(?:(\d+(?:\.\d*)?|\.\d+)|(<=|>=|<>|!=|==|\*\*|[-+*/^()<>=%])|(mod|and|or|not|div)\b)", re.I)


def expression(text: str) -> float | None:
    """The value of an arithmetic or logical expression; None where it isn't one."""
    tokens, at, text = [], 0, text.strip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            return None
        tokens.append((float(m[1]) if m[1] is not None else (m[2] or m[3]).lower()))
        at = m.end()
    if not tokens:
        return None
    pos = 0

    def peek():
        return tokens[pos] if pos < len(tokens) else None

    def take():
        nonlocal pos
        pos += 1
        return tokens[pos - 1]

    def left(lower, names: dict[str, Callable[[float, float], float]]):
        def f() -> float:
            x = lower()
            while isinstance(peek(), str) and peek() in names:
                x = names[take()](x, lower())
            return x

        return f

    def atom() -> float:
        if pos >= len(tokens):
            raise ValueError
        t = take()
        if t == "(":
            x = either()
            if take() != ")":
                raise ValueError
            return x
        if t in ("-", "+", "not"):
            x = atom() if t == "not" else power()
            return float(not x) if t == "not" else -x if t == "-" else x
        if isinstance(t, float):
            return t
        raise ValueError

    def power() -> float:
        x = atom()
        if peek() in ("^", "**"):
            take()
            return x ** power()
        return x

    truth = lambda f: lambda a, b: float(f(a, b))
    times = left(power, {"*": lambda a, b: a * b, "/": lambda a, b: a / b, "div": lambda a, b: a / b, "%": lambda a, b: a % b, "mod": lambda a, b: a % b})
    plus = left(times, {"+": lambda a, b: a + b, "-": lambda a, b: a - b})
    equal = {"=": lambda a, b: a == b, "==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<>": lambda a, b: a != b}
    order = {"<": lambda a, b: a < b, ">": lambda a, b: a > b, "<=": lambda a, b: a <= b, ">=": lambda a, b: a >= b}
    compare = left(plus, {k: truth(v) for k, v in (equal | order).items()})
    both = left(compare, {"and": lambda a, b: float(bool(a) and bool(b))})
    either = left(both, {"or": lambda a, b: float(bool(a) or bool(b))})
    try:
        value = either()
    except (ValueError, ArithmeticError, IndexError, TypeError):
        return None
    return float(value) if pos == len(tokens) and not isinstance(value, complex) and abs(value) < 1e300 else None


def shown_value(value: float | None) -> str:
    if value is None:
        return ""
    if value == int(value):
        return str(int(value))
    return f"{rounded(value, 2)}".rstrip("0").rstrip(".")


# parser functions


def _numeric(x: str) -> bool:
    return bool(re.fullmatch(r"-?\d+\.?\d*", x))


def _if_equal(a: list[str]) -> str:
    if len(a) < 2:
        return ""
    x, y = a[0].strip(), a[1].strip()
    same = float(x) == float(y) if _numeric(x) and _numeric(y) else x == y
    return _arg(a, 2) if same else _arg(a, 3)


def _arg(a: list[str], i: int, default: str = "") -> str:
    return a[i] if i < len(a) else default


def _switch(a: list[str]) -> str:
    value, waiting, fallback = a[0].strip(), set(), ""
    for case in a[1:]:
        key, eq, result = case.partition("=")
        if not eq:
            waiting.add(case.strip())
            fallback = case.strip()
            continue
        if key.strip() == "#default":
            fallback = result
        elif key.strip() == value or value in waiting:
            return result
        waiting = set()
    return fallback


def _if_error(a: list[str]) -> str:
    bad = re.search(r"""class=(?:"error"|'error')|expression error""", a[0], re.I)
    return _arg(a, 1) if bad else a[0] if len(a) < 2 else _arg(a, 2)


def _sub(a: list[str]) -> str:
    text, start = a[0], number(_arg(a, 1))
    start = start + len(text) if start < 0 else start
    if start < 0 or start > len(text):
        return ""
    if len(a) < 3:
        return text[start:]
    size = number(a[2])
    return text[start : start + size] if size >= 0 else ""


def _explode(a: list[str]) -> str:
    mark = _arg(a, 1)
    parts = a[0].split(mark) if mark and mark != " " else a[0].split() if mark else list(a[0])
    while parts and not parts[-1]:
        parts.pop()
    at = number(_arg(a, 2))
    at = at + len(parts) if at < 0 else at
    return parts[at] if 0 <= at < len(parts) else ""


def _filling(a: list[str]) -> str:
    short, pad = max(0, number(_arg(a, 1)) - len(a[0])), _arg(a, 2) or " "
    return (pad * (short // len(pad) + 1))[:short]


def _titleparts(a: list[str]) -> str:
    count, skip = number(_arg(a, 1)), number(_arg(a, 2))
    parts = a[0].split("/")
    parts = parts[skip:] if skip > 0 else parts[:skip] if skip < 0 else parts
    return "/".join(parts[:count] if count else parts)


def ordinal(n: int) -> str:
    return "th" if n % 100 in (11, 12, 13) else {1: "st", 2: "nd", 3: "rd"}.get(n % 10, "th")


_FORMATS = tuple("%Y|%B %d, %Y|%d %B %Y|%Y/%m/%d|%Y-%m-%d".split("|"))


def parsed_date(text: str) -> dt.datetime | None:
    for f in _FORMATS:
        try:
            return dt.datetime.strptime(text.strip(), f)
        except ValueError:
            continue
    return None


_TIME: dict[str, Callable[[dt.datetime], str]] = {
    "U": lambda t: str(int(t.replace(tzinfo=dt.UTC).timestamp())), "O": lambda t: "+0000", "T": lambda t: "UTC",
    "A": lambda t: "AM" if t.hour < 12 else "PM", "a": lambda t: "am" if t.hour < 12 else "pm", "s": lambda t: f"{t.second:02}", "i": lambda t: f"{t.minute:02}",
    "h": lambda t: f"{(t.hour - 1) % 12 + 1:02}", "g": lambda t: str((t.hour - 1) % 12 + 1), "G": lambda t: str(t.hour), "H": lambda t: f"{t.hour:02}",
    "W": lambda t: f"{t.isocalendar().week:02}", "w": lambda t: str(t.isoweekday() % 7), "N": lambda t: str(t.isoweekday()), "D": lambda t: W.DAYS[t.weekday()][:3], "l": lambda t: W.DAYS[t.weekday()],
    "S": lambda t: ordinal(t.day), "j": lambda t: str(t.day), "d": lambda t: f"{t.day:02}", "M": lambda t: W.MONTHS[t.month - 1][:3], "F": lambda t: W.MONTHS[t.month - 1],
    "n": lambda t: str(t.month), "m": lambda t: f"{t.month:02}", "y": lambda t: f"{t.year % 100:02}", "Y": lambda t: str(t.year),
}


def time_text(layout: str, t: dt.datetime) -> str:
    return "".join(_TIME[c](t) if c in _TIME else c for c in layout)


def _time(a: list[str], now: dt.datetime) -> str:
    t = parsed_date(a[1]) if len(a) > 1 and a[1].strip() else now
    return time_text(a[0], t) if t else ""


_FUNCTIONS: dict[str, Callable[[list[str]], str]] = {
    "if": lambda a: _arg(a, 1) if a[0].strip() else _arg(a, 2),
    "ifeq": _if_equal,
    "iferror": _if_error,
    "switch": _switch,
    "ifexpr": lambda a: _arg(a, 1) if expression(a[0]) else _arg(a, 2),
    "expr": lambda a: shown_value(expression(a[0])),
    "len": lambda a: str(len(a[0])),
    "pos": lambda a: str(a[0].find(_arg(a, 1))) if _arg(a, 1) in a[0] else "",
    "rpos": lambda a: str(a[0].rfind(_arg(a, 1))),
    "count": lambda a: str(a[0].count(a[1])) if _arg(a, 1) else "0",
    "sub": _sub,
    "replace": lambda a: a[0].replace(_arg(a, 1), _arg(a, 2)) if _arg(a, 1) else a[0],
    "explode": _explode,
    "urldecode": lambda a: urllib.parse.unquote_plus(a[0]),
    "urlencode": lambda a: urllib.parse.quote(a[0], safe="*-._").replace("~", "%7E"),
    "padleft": lambda a: _filling(a) + a[0],
    "padright": lambda a: a[0] + _filling(a),
    "titleparts": _titleparts,
}


def parser_function(content: str, now: dt.datetime = REFERENCE, keep: bool = False) -> str:
    name, colon, rest = content.partition(":")
    if not colon:
        return ""
    name, args = name[1:].lower(), pieces(rest)
    if name == "time":
        return _time(args, now)
    if f := _FUNCTIONS.get(name):
        return f(args)
    return f"{{{{{content}}}}}" if keep else ""


def evaluate(text: str, now: dt.datetime = REFERENCE, keep: bool = False) -> str:
    return outermost(text, "{{#", lambda c: parser_function(c, now, keep))


# magic words


def url_words(text: str) -> str:
    """Spaces as underscores, other reserved characters byte by byte."""
    return urllib.parse.quote(text.replace(" ", "_"), safe="_~")


def anchor(text: str) -> str:
    return re.sub(r"[^\w.-]", lambda m: "." + m[0].encode().hex().upper(), text.replace(" ", "_"))


def grouped(text: str) -> str:
    whole, dot, rest = text.partition(".")
    return re.sub(r"(?<=\d)(?=(?:\d{3})+(?!\d))", ",", whole) + (dot + rest if rest else "")


def _pages(title: str, space: str) -> dict[str, str]:
    full = f"{space}:{title}" if space else title
    parts = [x for x in title.split("/")]
    talk = f"{space} talk" if space else "Talk"
    names = {
        "PAGENAME": title, "FULLPAGENAME": full, "BASEPAGENAME": re.sub(r"/[^/]*\Z", "", title), "ROOTPAGENAME": parts[0] or title, "SUBPAGENAME": parts[-1] if len(parts) > 1 else title,
        "TALKPAGENAME": f"{talk}:{title}", "SUBJECTPAGENAME": full, "ARTICLEPAGENAME": full, "NAMESPACE": space, "TALKSPACE": talk, "SUBJECTSPACE": space, "ARTICLESPACE": space,
    }
    return names | {k + "E": url_words(v) for k, v in names.items()} | {"NAMESPACENUMBER": "" if space else "0"}


def _clock(t: dt.datetime) -> dict[str, str]:
    month = W.MONTHS[t.month - 1]
    now = {
        "YEAR": str(t.year), "MONTH": f"{t.month:02}", "MONTH1": str(t.month), "MONTHNAME": month, "MONTHNAMEGEN": month, "MONTHABBREV": month[:3], "DAY": str(t.day), "DAY2": f"{t.day:02}",
        "DOW": str(t.isoweekday() % 7), "DAYNAME": W.DAYS[t.weekday()], "TIME": f"{t:%H:%M}", "HOUR": f"{t:%H}", "WEEK": f"{t.isocalendar().week:02}", "TIMESTAMP": f"{t:%Y%m%d%H%M%S}",
    }
    return {prefix + k: v for prefix in ("CURRENT", "LOCAL") for k, v in now.items()}


_WORD = re.compile(r"\{\{\s*([A-Za-z][A-Za-z0-9]*)\s*\}\}")
_CALL = re.compile(r"(?i)\{{2}\s*(lcfirst|ucfirst|lc|uc|urlencode|anchorencode|padleft|padright|formatnum|plural|grammar|gender|int)\s*[:]\s*([^}]*)[}]{2}")
_PARTS = re.compile(r"\{{2}\s*[#]titleparts\s*:\s*([^}]+)\}{2}", re.I)


def _call(m: re.Match) -> str:
    name, text = m[1].lower(), m[2]
    args = text.split("|")
    if name in ("lc", "uc"):
        return text.lower() if name == "lc" else text.upper()
    if name in ("lcfirst", "ucfirst"):
        return (text[:1].lower() if name == "lcfirst" else text[:1].upper()) + text[1:]
    if name == "urlencode":
        return url_words(args[0].strip())
    if name == "anchorencode":
        return anchor(text.strip())
    if name in ("padleft", "padright"):
        if len(args) < 2 or not args[1].strip().isdigit():
            return m[0]
        fill = _filling([args[0], args[1], _arg(args, 2).lstrip() or "0"])
        return fill + args[0] if name == "padleft" else args[0] + fill
    if name == "formatnum":
        return re.sub(r"[\s,]", "", args[0]) if _arg(args, 1).strip().lower() == "r" else grouped(args[0].strip())
    if name == "int":
        return args[0].strip()
    return args[1].strip() if len(args) > 1 else m[0]


def _segments(m: re.Match) -> str:
    args = m[1].split("|")
    parts = args[0].strip().split("/")
    count = number(_arg(args, 1))
    parts = parts[max(1, number(_arg(args, 2, "1"))) - 1 :] if count >= 0 else parts[: len(parts) + count][max(1, number(_arg(args, 2, "1"))) - 1 :]
    return "/".join(parts[:count] if count > 0 else parts)


def magic(text: str, title: str, space: str = "", now: dt.datetime = REFERENCE) -> str:
    """Page names, times of `now`, and string functions; unknown words stay."""
    if "{{" not in text:
        return text
    if _WORD.search(text):
        known = _pages(title or "", space) | _clock(now)
        text = _WORD.sub(lambda m: known.get(m[1].upper(), m[0]), text)
    return _PARTS.sub(_segments, _CALL.sub(_call, text))
