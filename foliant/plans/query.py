"""The query language: free text and ``key:value`` qualifiers.

Tokens are parted by blanks. A token that is a valid qualifier becomes a criterion;
all others, joined by one blank each, are the phrase that names must contain.
"""

from __future__ import annotations

import math
import os
import re
from dataclasses import dataclass, field
from datetime import date, timedelta

from ..functions.fold import fold, fold_ascii
from ..schema import CATEGORY_KEYS, DIRECTORY, FILE, SYMLINK

DAY = 86_400
MAX_U64 = (1 << 64) - 1

# Words of the language.
KINDS = {"file": FILE, "folder": DIRECTORY, "dir": DIRECTORY, "directory": DIRECTORY, "symlink": SYMLINK, "link": SYMLINK}
CATEGORY_WORDS = {"images": 1, "image": 1, "text": 2, "documents": 3, "docs": 3, "doc": 3, "spreadsheets": 4, "sheets": 4, "audio": 5, "video": 6, "code": 7, "archives": 8, "archive": 8, "other": 0, "uncategorized": 0}
UNITS = {"": 0, "b": 0, "k": 1, "kb": 1, "m": 2, "mb": 2, "g": 3, "gb": 3, "t": 4, "tb": 4}
SPANS = {"today": 1, "week": 7, "month": 30, "year": 365}
KIND_WORDS = {FILE: "file", DIRECTORY: "folder", SYMLINK: "symlink"}


@dataclass(frozen=True)
class Kind:
    value: int
    negated: bool = False


@dataclass(frozen=True)
class Extension:
    """``value`` is folded and may be a comma list; a segment may have dots inside."""

    value: str
    negated: bool = False

    @property
    def segments(self) -> list[str]:
        return [s for s in self.value.split(",") if s]


@dataclass(frozen=True)
class Size:
    op: str
    value: int
    upper: int = 0


@dataclass(frozen=True)
class Date:
    op: str
    value: int
    upper: int = 0


@dataclass(frozen=True)
class Category:
    value: int
    negated: bool = False


@dataclass(frozen=True)
class Path:
    value: str
    negated: bool = False


Criterion = Kind | Extension | Size | Date | Category | Path


@dataclass(frozen=True)
class Query:
    text: str = ""
    criteria: tuple[Criterion, ...] = field(default=())


def parse(text: str, now: int) -> Query:
    """``now``: unix seconds that ``date:today`` and the like count from."""
    found = [(token, qualifier(token, now)) for token in text.split(" ") if token]
    return Query(" ".join(t for t, c in found if c is None), tuple(c for _, c in found if c is not None))


def qualifier(token: str, now: int) -> Criterion | None:
    """The criterion that a token stands for; none: it is text. A ``!`` before size and date has no effect."""
    negated = token.startswith("!")
    key, colon, value = token[negated:].partition(":")
    if not (key and colon and value):
        return None
    key, word = fold_ascii(key), fold_ascii(value)
    match key:
        case "kind":
            return Kind(KINDS[word], negated) if word in KINDS else None
        case "ext":
            return Extension(fold(value), negated) if len(value.encode()) <= 64 and value.strip(",") else None
        case "size":
            return _size(value)
        case "date":
            return _date(value, word, now)
        case "cat":
            return Category(CATEGORY_WORDS[word], negated) if word in CATEGORY_WORDS else None
        case "path":
            return Path(value, negated) if len(value.encode()) <= 255 else None
    return None


def parse_size(text: str) -> int | None:
    """Bytes of ``1.5mb`` and the like, 1024 to a step; none if it is no size below 2^64."""
    found = re.fullmatch(r"([0-9]*\.?[0-9]*)([A-Za-z]*)", text)
    if not found or not re.search("[0-9]", found[1]) or (power := UNITS.get(found[2].lower())) is None:
        return None
    if "." not in found[1]:
        if len(found[1].lstrip("0")) > len(str(MAX_U64)):
            return None  # and Python converts no number of over 4,300 digits
        size = int(found[1].lstrip("0") or "0") << (10 * power)
        return size if size <= MAX_U64 else None
    product = float(found[1]) * 1024.0**power
    return int(product) if math.isfinite(product) and product < float(MAX_U64) else None


def _size(value: str) -> Size | None:
    low, dots, high = value.partition("..")
    if dots:
        a, b = parse_size(low), parse_size(high)
        return None if a is None or b is None else Size("range", a, b)
    for sign, op in ((">=", "gte"), ("<=", "lte"), (">", "gt"), ("<", "lt"), ("", "eq")):
        if value.startswith(sign) and len(value) > len(sign) - (len(sign) == 2):
            size = parse_size(value[len(sign) :])
            return None if size is None else Size(op, size)
    return None


def parse_date(text: str) -> int | None:
    """Unix seconds of ``YYYY-MM-DD`` at midnight UTC; none if there is no such day."""
    if not re.fullmatch(r"[0-9]{4}-[0-9]{2}-[0-9]{2}", text, re.ASCII):
        return None
    try:
        return (date.fromisoformat(text) - date(1970, 1, 1)).days * DAY
    except ValueError:
        return None


def _date(value: str, word: str, now: int) -> Date | None:
    if word in SPANS:
        return Date("gte", now - SPANS[word] * DAY)
    low, dots, high = value.partition("..")
    if dots:
        a, b = parse_date(low), parse_date(high)
        return None if a is None or b is None else Date("range", a, b + DAY)
    if value[0] in "<>":
        day = parse_date(value[1:])
        return None if day is None else Date("gt" if value[0] == ">" else "lt", day)
    day = parse_date(value)
    return None if day is None else Date("range", day, day + DAY)


SIGNS = {"gt": ">", "lt": "<", "gte": ">=", "lte": "<=", "eq": "", "range": ""}


def size_text(n: int) -> str:
    """The largest unit that divides, else one decimal of the largest up to mb that is reached."""
    if n == 0:
        return "0"
    for power, unit in ((3, "gb"), (2, "mb"), (1, "kb")):
        if n % (1 << (10 * power)) == 0:
            return f"{n >> (10 * power)}{unit}"
    for power, unit in ((2, "mb"), (1, "kb")):
        if n >= 1 << (10 * power):
            return f"{n / (1 << (10 * power)):.1f}{unit}"
    return f"{n}b"


def date_text(seconds: int) -> str:
    return "1970-01-01" if seconds <= 0 else (date(1970, 1, 1) + timedelta(days=seconds // DAY)).isoformat()


def format_criterion(c: Criterion, now: int) -> str:
    """A criterion as it is typed."""
    sign = "!" if getattr(c, "negated", False) else ""
    match c:
        case Kind():
            return f"{sign}kind:{KIND_WORDS[c.value]}"
        case Extension():
            return f"{sign}ext:{c.value}"
        case Category():
            return f"{sign}cat:{CATEGORY_KEYS[c.value]}"
        case Path():
            return f"{sign}path:{c.value}"
        case Size():
            return f"size:{size_text(c.value)}..{size_text(c.upper)}" if c.op == "range" else f"size:{SIGNS[c.op]}{size_text(c.value)}"
    if c.op == "gte":
        ago = now - c.value
        for word, least, most in (("today", 0, DAY + 60), ("week", 6 * DAY, 8 * DAY), ("month", 29 * DAY, 31 * DAY), ("year", 364 * DAY, 366 * DAY)):
            if least <= ago <= most:
                return f"date:{word}"
    if c.op == "range":
        return f"date:{date_text(c.value)}..{date_text(c.upper - DAY)}"
    return f"date:{SIGNS[c.op] if c.op in ('gt', 'lt') else ''}{date_text(c.value)}"


@dataclass(frozen=True)
class StructuredFilter:
    """The coarser form that facets edit: one category, a set of extensions, and all else as text."""

    category: str | None = None
    extensions: frozenset[str] = frozenset()
    text: str = ""

    @classmethod
    def parse(cls, query: str) -> StructuredFilter:
        category, extensions, text = None, set(), []
        for token in query.split(" "):
            low = token.lower()
            if low.startswith("cat:"):
                category = low[4:] or category
            elif low.startswith("ext:"):
                extensions |= {fold(token[4:])} - {""}
            elif token:
                text.append(token)
        return cls(category, frozenset(extensions), " ".join(text))

    @property
    def encoded(self) -> str:
        parts = [f"cat:{self.category}"] if self.category is not None else []
        return " ".join([*parts, *(f"ext:{e}" for e in sorted(self.extensions)), *([self.text] if self.text else [])])

    @property
    def is_empty(self) -> bool:
        return self == StructuredFilter()

    def click_extension(self, ext: str, category: str, additive: bool) -> StructuredFilter:
        """After a click on an extension of a category's facet: replace or toggle; additive clicks gather."""
        if additive:
            if ext in self.extensions:
                return StructuredFilter(self.category, self.extensions - {ext}, self.text)
            kept = category if not self.extensions or self.category == category else None
            return StructuredFilter(kept, self.extensions | {ext}, self.text)
        if self.extensions == {ext}:
            return StructuredFilter(self.category, frozenset(), self.text)
        return StructuredFilter(category, frozenset({ext}), self.text)

    def shows(self, ext: str) -> bool:
        """Whether an extension is selected, alone or in a comma list."""
        return any(ext in e.split(",") for e in self.extensions)


def saved_already(query: str, saved: list[str]) -> bool:
    now = StructuredFilter.parse(query)
    return not now.is_empty and any(StructuredFilter.parse(s) == now for s in saved)


def resolve_path(text: str, base: str, home: str | None = None) -> str:
    """``~``, ``~/x``, absolute and relative paths, standardised."""
    home = home or os.path.expanduser("~")
    text = text.strip()
    if text == "~" or text.startswith("~/"):
        text = home + text[1:]
    path = os.path.normpath(text if text.startswith("/") else os.path.join(base, text))
    return path[1:] if path.startswith("//") else path


def scope_of(scope: str, current: str, max_depth: int) -> tuple[str, int]:
    """Root and depth of folder, subfolders and everywhere."""
    return ("/" if scope == "everywhere" else current, 1 if scope == "folder" else max_depth)


def promoted(scope: str, text: str) -> str:
    """Typing a text in a folder searches its subfolders too."""
    return "subfolders" if text and scope == "folder" else scope
