"""Case folding that never changes a string's length in UTF-8.

Rule: Unicode simple case folding (status C and S), restricted to pairs whose two
sides take the same number of bytes. Python's own tables give all pairs of its
Unicode version; those that later versions add are listed beside.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

ASCII_UPPER, ASCII_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Fixed values: (first, last, distance) of simple foldings up to Unicode 17 that Python 3.13 lacks; FB05 folds to
# FB06 though its full folding is two letters.
LATER = ((0x1C89, 0x1C89, 1), (0xA7CC, 0xA7CC, 1), (0xA7CE, 0xA7CE, 1), (0xA7D2, 0xA7D2, 1), (0xA7D4, 0xA7D4, 1), (0xA7DA, 0xA7DA, 1), (0xFB05, 0xFB05, 1), (0x10D50, 0x10D65, 0x20), (0x16EA0, 0x16EB8, 0x1B))


@lru_cache(1)
def pairs() -> dict[str, str]:
    out = {}
    for code in (*range(0xD800), *range(0xE000, 0x20000)):
        c = chr(code)
        f = c.casefold()
        if len(f) != 1:  # a full folding; the simple one, if any, is the lower case
            f = c.lower()
        if len(f) == 1 and f != c and len(f.encode()) == len(c.encode()):
            out[c] = f
    for first, last, distance in LATER:
        out.update({chr(k): chr(k + distance) for k in range(first, last + 1)})
    return out


@lru_cache(1)
def tables() -> tuple[str, str]:
    """All sources and all targets, as translate() takes them."""
    return "".join(pairs()), "".join(pairs().values())


def fold(text: str) -> str:
    return text.translate({ord(a): b for a, b in pairs().items()})


def fold_bytes(raw: bytes) -> bytes:
    """Of bytes that may not be UTF-8: what isn't stays byte for byte."""
    return fold(raw.decode(errors="surrogateescape")).encode(errors="surrogateescape")


def fold_ascii(text: str) -> str:
    return text.translate({ord(a): b for a, b in zip(ASCII_UPPER, ASCII_LOWER, strict=True)})


def _unless_ascii(c: Column, sources: str, targets: str) -> Column:
    """translate() makes a string of every character and looks it up; text of single bytes alone has a short way to the same."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, sources, targets))


def folded(c: Column) -> Column:
    return _unless_ascii(c, *tables())


def lower_ascii(c: Column) -> Column:
    return _unless_ascii(c, ASCII_UPPER, ASCII_LOWER)
