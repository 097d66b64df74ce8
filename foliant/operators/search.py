"""Search, listing and sorting."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fold import fold, fold_ascii, lower_ascii
from ..functions.names import category_name, kind_label, row_extension
from ..plans import predicates
from ..plans.query import Query, parse
from ..schema import DIRECTORY, MAX_DEPTH, RESULT, SCHEMA_VERSION
from ..sources.shared import written

#: Default caps: of the engine, of the client library, and of what one screen asks for.
ENGINE_CAP, CLIENT_CAP, SCREEN_CAP = 100, 100_000, 2_000


class QueryTooLong(ValueError):
    """The phrase has over 256 bytes."""


class Cancelled(RuntimeError):
    """The query was cancelled, before it began or while it ran."""


def matching(entries: DataFrame, query: str | Query, scope: str = "/", max_depth: int = MAX_DEPTH, now: int = 0, version: int = SCHEMA_VERSION) -> DataFrame:
    """All entries that match, uncapped and in no order: one filter over stored columns."""
    scope = scope or "/"
    q = query if isinstance(query, Query) else parse(query, now)
    if not q.text and not q.criteria and scope == "/" and max_depth == MAX_DEPTH:
        return entries.limit(0)
    if len(q.text.encode()) > 256:
        raise QueryTooLong(q.text)
    text = (fold if version >= 7 else fold_ascii)(q.text)
    for p in (F.col("name_folded").contains(text) if text else None, predicates.in_scope(scope, max_depth), predicates.all_of(q.criteria)):
        if p is not None:
            entries = entries.where(p)
    return entries


def search(entries: DataFrame, query: str | Query, scope: str = "/", max_depth: int = MAX_DEPTH, max_results: int = ENGINE_CAP, now: int = 0, version: int = SCHEMA_VERSION) -> DataFrame:
    """The first ``max_results`` matches in order of entry_id: each task keeps that many, none sorts all."""
    return matching(entries, query, scope, max_depth, now, version).select("entry_id", *RESULT).orderBy("entry_id").limit(max_results)


def list_folder(entries: DataFrame, path: str, max_results: int = SCREEN_CAP) -> DataFrame:
    return search(entries, "", path, 1, max_results)


def engine_order(column: str, ascending: bool = True, folders_first: bool = False) -> list[tuple[Column, bool]]:
    """The engine's order by name, size, mtime or category, as keys and whether each ascends; ties by name and folder, never reversed."""
    name = lower_ascii(F.col("name"))
    key = {"name": name, "size": F.col("size"), "mtime": F.col("mtime"), "category": category_name(F.col("category"))}[column]
    first = [(F.when(F.col("kind") == DIRECTORY, 0).otherwise(1), True)] if folders_first else []
    return [*first, (key, ascending), (name, True), (F.col("dir_path"), True)]


def sort_keys(column: str, ascending: bool = True, folders_first: bool = False) -> list[Column]:
    return [key.asc() if up else key.desc() for key, up in engine_order(column, ascending, folders_first)]


def screen_sort_keys(column: str, ascending: bool = True, folders_on_top: bool = False) -> list[Column]:
    """Keys of the screen's order: name, size, modified, kind or ext; ties by name, then as they came."""
    name = F.lower(F.col("name"))
    folder = F.when(F.col("kind") == DIRECTORY, 0).otherwise(1)
    key = {"name": name, "size": F.col("size"), "modified": F.col("mtime"), "kind": kind_label(F.col("kind"), F.col("category")), "ext": row_extension(F.col("name"), F.col("kind"))}[column]
    first = [folder] if folders_on_top or (column == "name" and ascending) else []
    return [*first, key.asc() if ascending else key.desc(), *([name.asc()] if column != "name" else []), F.col("entry_id").asc()]


def sort_results(rows: DataFrame, column: str, ascending: bool = True, folders_first: bool = False) -> DataFrame:
    return rows.orderBy(*sort_keys(column, ascending, folders_first))


def screen_sort(rows: DataFrame, column: str, ascending: bool = True, folders_on_top: bool = False) -> DataFrame:
    return rows.orderBy(*screen_sort_keys(column, ascending, folders_on_top))


def search_sorted(entries: DataFrame, query: str, column: str = "name", ascending: bool = True, folders_on_top: bool = False, max_results: int = SCREEN_CAP, **named: object) -> DataFrame:
    """Capped in entry order first, then sorted: not the top of the sort key."""
    return screen_sort(search(entries, query, max_results=max_results, **named), column, ascending, folders_on_top)


def rank_rows(rows: DataFrame, keys: list[Column | tuple[Column, bool]], name: str = "rank") -> DataFrame:
    """``rows`` with each one's place, from 1, in the order of ``keys``, which should tell all rows apart.

    Keys that are computed should come as pairs, with whether they ascend: they become
    columns. A sort takes expressions anew for both rows of every comparison.

    No window over everything: rows go to ranges of the keys, are numbered inside
    their range, and the ranges' sizes, one row each, say where each begins. The
    ranges are written in the shared folder first, since the two have to agree.
    """
    part, place = "__part", "__place"
    inside = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    computed = {f"__key{k}": key for k, key in enumerate(keys) if isinstance(key, tuple)}
    order = [key if isinstance(key, Column) else F.asc(f"__key{k}") if key[1] else F.desc(f"__key{k}") for k, key in enumerate(keys)]
    keyed = rows.select("*", *(key.alias(at) for at, (key, _) in computed.items()))
    held = written(keyed.repartitionByRange(*order).sortWithinPartitions(*order).select(*rows.columns, F.spark_partition_id().alias(part), inside.alias(place)), "ranked")
    begin, sofar = [], 0
    for r in sorted(held.groupBy(part).count().collect()):
        begin.append((r[0], sofar))
        sofar += r[1]
    starts = rows.sparkSession.createDataFrame(begin, f"{part} int, __begin long")
    return held.join(F.broadcast(starts), part).withColumn(name, F.col(place) + F.col("__begin") + 1).select(name, *rows.columns)


class CancelToken:
    """Cancels the Spark jobs of the query that it is given to."""

    def __init__(self) -> None:
        self.tag = f"query-{uuid.uuid4().hex}"
        self.cancelled = False
        self._sessions: list = []

    def cancel(self) -> None:
        self.cancelled = True
        for spark in self._sessions:
            spark.sparkContext.cancelJobsWithTag(self.tag)

    def run(self, df: DataFrame) -> list:
        """Collect ``df``; raises Cancelled if the token was or gets cancelled."""
        if self.cancelled:
            raise Cancelled
        context = df.sparkSession.sparkContext
        self._sessions.append(df.sparkSession)
        context.addJobTag(self.tag)
        try:
            rows = df.collect()
        except Exception as why:
            if self.cancelled:
                raise Cancelled from why
            raise
        finally:
            context.removeJobTag(self.tag)
            self._sessions.pop()
        if self.cancelled:
            raise Cancelled
        return rows


class QuerySession:
    """Delivers the newest query's rows alone; earlier rows stay until then, and can be sorted anew without a query."""

    def __init__(self) -> None:
        self.generation = 0
        self.rows: list = []
        self._token: CancelToken | None = None
        self._lock = threading.Lock()

    def run(self, make: Callable[[], DataFrame]) -> bool:
        """True if the rows were delivered; false if a newer query came meanwhile."""
        with self._lock:
            self.generation += 1
            mine, previous, self._token = self.generation, self._token, CancelToken()
            token = self._token
        if previous:
            previous.cancel()
        try:
            rows = token.run(make())
        except Cancelled:
            return False
        with self._lock:
            if mine != self.generation:
                return False
            self.rows = rows
        return True

    def resort(self, spark, column: str, ascending: bool = True, folders_on_top: bool = False) -> list:
        if self.rows:
            self.rows = screen_sort(spark.createDataFrame(self.rows), column, ascending, folders_on_top).collect()
        return self.rows
