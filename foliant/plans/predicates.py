"""Criteria as Column predicates over stored columns, so Parquet can push them down."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.names import strip_slash
from .query import Category, Criterion, Date, Extension, Kind, Path, Size

MAX_LONG = (1 << 63) - 1


def number(c: Column, op: str, value: int, upper: int) -> Column:
    """A comparison with a number that may lie beyond what the column can hold."""
    big = value > MAX_LONG
    match op:
        case "eq":
            return F.lit(False) if big else c == value
        case "gt" | "gte":
            return F.lit(False) if big else c > value if op == "gt" else c >= value
        case "lt" | "lte":
            return c.isNotNull() if big else c < value if op == "lt" else c <= value
    return F.lit(False) if big else c.between(value, min(upper, MAX_LONG))


def of(criterion: Criterion) -> Column:
    """True for rows that match, by the columns name_folded, dir_path, size, mtime, kind and category."""
    match criterion:
        case Kind():
            match_ = F.col("kind") == criterion.value
        case Category():
            match_ = F.col("category") == criterion.value
        case Path():
            match_ = F.col("dir_path").contains(criterion.value)
        case Extension():
            # a dot before the segment: the name is longer than it; folding keeps lengths and makes no dots
            match_ = reduce(or_, (F.col("name_folded").endswith("." + s) for s in criterion.segments))
        case Size():
            return number(F.col("size"), criterion.op, criterion.value, criterion.upper)
        case Date():
            return number(F.col("mtime"), criterion.op, criterion.value, criterion.upper)
    return ~match_ if criterion.negated else match_


def all_of(criteria: tuple[Criterion, ...]) -> Column | None:
    """All criteria; those of extensions that aren't negated are one group, of which one is enough."""
    group = [c for c in criteria if isinstance(c, Extension) and not c.negated]
    rest = [of(c) for c in criteria if c not in group]
    if group:
        rest.append(reduce(or_, map(of, group)))
    return reduce(and_, rest) if rest else None


def in_scope(scope: str, max_depth: int, dir_path: Column | None = None) -> Column | None:
    """Depth 1: rows right in the folder; any other depth: the whole subtree."""
    c = F.col("dir_path") if dir_path is None else dir_path
    scope = strip_slash(scope)
    if max_depth == 1:
        return c == scope
    return None if scope == "/" else (c == scope) | c.startswith(scope + "/")
