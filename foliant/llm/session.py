"""Session helpers shared by the text operators."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import Run, fresh_path, passing, shared_dir, written

__all__ = ["ARROW_BYTES", "Run", "bounded_batches", "distinct_rows", "fresh_path", "free_name", "passing", "room_for", "sample", "share_of", "shared_dir", "written"]

#: Bytes in one Arrow batch at most (but one row at least); a batch is what a Python worker holds at a time.
ARROW_BYTES = 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes: documents may be long.

    The bound is the same for all plans of the library, so it doesn't matter that
    the session holds it until they run; a smaller one of the user's stays.
    How many rows a function takes at a time is its own affair, see ``arrow_batches``.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    held = re.fullmatch(r"(\d+)b?", spark.conf.get(name).lower())
    if not held or not 0 < int(held[1]) <= ARROW_BYTES:
        spark.conf.set(name, str(ARROW_BYTES))


def free_name(df: DataFrame, stem: str) -> str:
    """``stem``, made longer until no column of ``df`` has that name."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem += "_"
    return stem


def room_for(df: DataFrame, name: str | None, stem: str) -> tuple[DataFrame, str]:
    """``df`` and the name of a column to add: ``name``, in place of a column of that name, or else a free one like ``stem``."""
    return (df, free_name(df, stem)) if name is None else (df.drop(name), name)


def distinct_rows(*by: str) -> Column:
    """An aggregate: about how many distinct rows there are, by ``by``; a sketch, so repeats cost nothing and few are counted as they are."""
    return F.approx_count_distinct(F.xxhash64(*by), 0.02)


def share_of(rows: DataFrame, wanted: int, *by: str) -> float:
    """The share of distinct rows that gives somewhat more than ``wanted`` of them: ``sample`` has equal rows once, however often they repeat."""
    return min(1.0, (1.1 * wanted + 20) / max(1, rows.agg(distinct_rows(*by)).first()[0]))


def sample(rows: DataFrame, share: float | Column, *by: str) -> tuple[DataFrame, Column]:
    """About a ``share`` of the distinct rows, even over a hash of the columns ``by``; and the order by which to limit them."""
    at = F.pmod(F.xxhash64(*by), F.lit(1 << 53))
    share = F.lit(share) if isinstance(share, float) else share
    return rows.where(at < share * float(1 << 53)).distinct(), at
