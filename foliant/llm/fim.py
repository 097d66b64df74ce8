"""Fill-in-the-middle: texts rearranged to prefix, suffix and middle between markers.

A text is cut into units, the matches of a pattern from left to right (by default
code points). A text's id and a seed choose, through a SHA-256 digest, whether it
is rearranged, where its two cuts lie and which order it gets:

* psm: ``<P>`` prefix ``<S>`` suffix ``<M>`` middle,
* spm: ``<S>`` suffix ``<P>`` prefix ``<M>`` middle,
* plain: the text as it is, also if it is empty or holds a marker itself.

No text that holds a marker is rearranged and no marker can overlap another, so
``restore`` gives the exact text back.

One Arrow batch at a time: the ends of a text's units are gathered in a compact
array, and two lookups there are all that a text's cuts need.

Null texts are empty texts; a null id counts as an empty string; equal rows give
equal rows. Characters between or behind matches of an own pattern belong to the
unit behind them, those at the end to the last part; nothing is dropped.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .session import bounded_batches

#: The markers, percent of texts that are rearranged, percent of those with the suffix first.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
RATE, SPM_RATE = 90, 20
SEED = 1
CODE_POINT = r"(?s:.)"
#: Columns of ``transform``'s struct.
PARTS = "n long, form string, prefix_chars long, middle_chars long, output string, output_sha256 string, restored_sha256 string"


@dataclass(frozen=True)
class Plan:
    """How texts are rearranged."""

    rate: int = RATE
    spm_rate: int = SPM_RATE
    seed: int = SEED
    unit: str = CODE_POINT


def unit_ends(text: str, pattern: regex.Pattern) -> array:
    """Where each unit ends: four bytes a unit, and no other object of it stays."""
    return array("I", (m.end() for m in pattern.finditer(text)))


def draws(seed: int, row_id: object) -> tuple[int, int, int, int]:
    """Four numbers of 32 bits, fixed by seed and id."""
    digest = hashlib.sha256(f"{seed}:{'' if row_id is None else row_id}".encode()).digest()
    return tuple(int.from_bytes(digest[k : k + 4], "big") for k in range(0, 16, 4))


def rearrange(text: str, row_id: object, plan: Plan, pattern: regex.Pattern) -> tuple[int, str, int | None, int | None, str]:
    """Units, form, characters of prefix and of middle (none if plain), and the output of one text."""
    ends = unit_ends(text, pattern)
    n = len(ends)
    h1, h2, h3, h4 = draws(plan.seed, row_id)
    if not text or any(m in text for m in (PREFIX, SUFFIX, MIDDLE)) or h3 % 100 >= plan.rate:
        return n, "plain", None, None, text
    first, last = sorted((h1 % (n + 1), h2 % (n + 1)))
    i, j = (ends[k - 1] if k else 0 for k in (first, last))
    prefix, middle, suffix = text[:i], text[i:j], text[j:]
    if h4 % 100 < plan.spm_rate:
        return n, "spm", i, j - i, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", i, j - i, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def restore(output: str, form: str) -> str:
    """The text that ``rearrange`` was given, from its output and form alone."""
    if form == "plain":
        return output
    inner = SUFFIX if form == "psm" else PREFIX
    head, middle = output[len(PREFIX) :].rsplit(MIDDLE, 1)
    one, other = head.split(inner, 1)
    return one + middle + other if form == "psm" else other + middle + one


def _sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def transform(row_id: Column, text: Column, plan: Plan = Plan()) -> Column:
    """A struct of PARTS for each text; ``restored_sha256`` is of the text rebuilt from ``output``."""

    @F.pandas_udf(PARTS)
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        pattern = regex.compile(plan.unit)
        for ids, texts in batches:
            rows = []
            for i, t in zip(ids, texts, strict=True):
                row = rearrange(t or "", i, plan, pattern)
                output = row[-1]
                rows.append((*row, _sha256(output), _sha256(restore(output, row[1]))))
            out = pd.DataFrame(rows, columns=[part.split()[0] for part in PARTS.split(", ")])
            yield out.astype({"prefix_chars": "Int64", "middle_chars": "Int64", "n": "int64"})

    return run(row_id.cast("string"), text)


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", plan: Plan = Plan(), name: str = "fim") -> DataFrame:
    """``docs`` with one more column: a struct of PARTS, in place of a column of that name. No shuffle."""
    bounded_batches(docs.sparkSession)
    return docs.withColumn(name, transform(F.col(id_col), F.col(text_col), plan))


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", plan: Plan = Plan()) -> DataFrame:
    """A row per document: what was done, and digests of output and restored text."""
    done = fill_in_middle(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), plan=plan)
    return done.select("doc_id", *(f"fim.{part}" for part in ("n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")))
