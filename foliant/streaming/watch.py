"""Rebuilding a catalog as changes come in.

Changes are a stream of paths: from another system, or what a new scan differs in
from the snapshot (``changes``, ``record``). Each micro-batch counts the relevant
ones, and a trigger decides whether the snapshot is built anew: daily, after many
changes, or some time after few. A heartbeat makes micro-batches when nothing
changes, so few changes don't wait for the next one.

The trigger's count and times lie beside the stream's checkpoint, with the number of the
micro-batch that they include. A restart goes on from there: a batch that is delivered
again is not counted again, and a rebuild that was cut off is done again.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.names import is_under, join_path
from ..schema import DIRECTORY
from ..sources.catalog import Store

# How often is looked, how long few changes wait, how many don't, and how old a scan may get; seconds.
POLL = 2.0
INTERVAL = 30.0
THRESHOLD = 1000
DAILY = 24 * 3600.0


def should_rebuild(dirty: int, since_rebuild: float, since_full: float) -> bool:
    return since_full >= DAILY or dirty >= THRESHOLD or (dirty > 0 and since_rebuild >= INTERVAL)


@dataclass
class RebuildTrigger:
    """Counts changes and rebuilds. The count is taken back before a rebuild, so one that
    fails waits for a new change; its time does not count as one of a rebuild.

    With a ``ledger`` (a text's reader and writer) what it knows outlives the driver.
    """

    rebuild: Callable[[], None]
    started: float
    dirty: int = 0
    batch: int = -1
    ledger: tuple[Callable[[], str | None], Callable[[str], None]] | None = None

    def __post_init__(self) -> None:
        self.last = self.full = self.started
        self.rebuilds = self.failures = 0
        self.cut_off: str | None = None
        if self.ledger and (text := self.ledger[0]()):
            held = json.loads(text)
            self.dirty, self.batch, self.last, self.full, self.cut_off = (held[k] for k in ("dirty", "batch", "last", "full", "rebuilding"))

    def _save(self, rebuilding: str | None = None) -> None:
        if self.ledger:
            self.ledger[1](json.dumps({"dirty": self.dirty, "batch": self.batch, "last": self.last, "full": self.full, "rebuilding": rebuilding}))

    def step(self, changes: int, now: float, batch: int | None = None) -> bool:
        """True if it has rebuilt. A ``batch`` that was counted before counts nothing."""
        if batch is None or batch > self.batch:
            self.dirty += changes
            self.batch = self.batch if batch is None else batch
        daily = now - self.full >= DAILY or self.cut_off == "daily"
        if not self.cut_off and not should_rebuild(self.dirty, now - self.last, now - self.full):
            if changes:
                self._save()
            return False
        self.dirty = 0
        self._save("daily" if daily else "changes")  # a driver that dies from here on rebuilds again
        self.cut_off = None
        try:
            self.rebuild()
        except Exception:
            self.failures += 1
            self._save()
            return False
        self.rebuilds += 1
        self.last = now
        if daily:
            self.full = now
        self._save()
        return True


def kept_trigger(spark: SparkSession, rebuild: Callable[[], None], started: float, checkpoint: str) -> RebuildTrigger:
    """A trigger whose ledger lies beside a stream's checkpoint: what an earlier one there knew, or a new one."""
    store = Store(spark, f"{checkpoint.rstrip('/')}-trigger")
    return RebuildTrigger(rebuild, started, ledger=(lambda: store.read("STATE"), lambda text: store.replace("STATE", text)))


def relevant(changes: DataFrame, path: str, own_output: str | None) -> DataFrame:
    """Changes but those under the catalog's own folder."""
    return changes if own_output is None else changes.where(~is_under(F.col(path), own_output))


def watch(changes: DataFrame, path: str, trigger: RebuildTrigger, own_output: str | None, checkpoint: str, clock: Callable[[], float] = time.time, available_now: bool = False) -> StreamingQuery:
    """Start the loop over a stream of changes. Start it before the first full build, so that no change is missed.

    If they have a column ``at``, the changes of one path at one time are one.
    """
    timed = "at" in changes.columns

    def batch(df: DataFrame, number: int) -> None:
        found = df.where("path is not null")
        trigger.step((found.distinct() if timed else found).count(), clock(), number)

    paths = relevant(changes, path, own_output).select(F.col(path).alias("path"), *(["at"] if timed else []))
    if available_now:
        return paths.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    beats = changes.sparkSession.readStream.format("rate").option("rowsPerSecond", 1).option("numPartitions", 1).load()
    paths = paths.unionByName(beats.select(F.lit(None).cast("string").alias("path")), allowMissingColumns=True)
    return paths.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(processingTime=f"{POLL:g} seconds").start()


def watch_and_build(first_build: Callable[[], object], *args: object, **named: object) -> StreamingQuery:
    """Start the loop (see ``watch``), then build for the first time: no change is missed in between. If the build fails the loop ends."""
    query = watch(*args, **named)
    try:
        first_build()
    except BaseException:
        query.stop()
        raise
    return query


CHANGES = "path string, change string"


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, change): entries that were added, removed or modified between two scans of a tree.

    One full join by path. Rows that share a path count as one entry, modified if their
    number, or the least or greatest of them, differ. A folder's own size is that of
    what lies in it and is not compared.
    """

    def side(df: DataFrame, mark: str) -> DataFrame:
        row = F.struct(F.when(F.col("kind") == DIRECTORY, 0).otherwise(F.col("size")).alias("size"), "mtime", "kind")
        state = F.struct(F.count(F.lit(1)).alias("n"), F.min(row).alias("least"), F.max(row).alias("most"))
        return df.groupBy(join_path(F.col("dir_path"), F.col("name")).alias("path")).agg(state.alias(mark))

    both = side(before, "was").join(side(after, "now"), "path", "full")
    change = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("was") != F.col("now"), "modified")
    return both.select("path", change.alias("change")).where("change is not null")


def record(before: DataFrame, after: DataFrame, folder: str) -> None:
    """Append the changes to a folder of Parquet files; ``recorded`` is the stream of them."""
    changes(before, after).write.mode("append").parquet(folder)


def recorded(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema(CHANGES).parquet(folder)


def ticks(events: DataFrame, root: str, second: Column) -> DataFrame:
    """Changes of each root counted by polls: (root, tick, changes)."""
    return events.groupBy(F.col(root).alias("root"), F.floor(second / POLL).alias("tick")).agg(F.count("*").alias("changes"))


def replay(counted: DataFrame, started: int) -> DataFrame:
    """(root, rebuilt_at, dirty): the rebuilds that a watcher of each root would have made.

    A root's polls are at most one row for each two seconds, whatever the number of
    changes, and roots go to tasks of their own. Between two polls with changes the
    trigger fires at most for what waits, and daily; these are found by arithmetic.
    """

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        root = pdf["root"].iloc[0]
        last = full = float(started)
        dirty = 0

        def fire(now: float) -> None:
            nonlocal last, full, dirty
            daily = now - full >= DAILY
            out.append((root, int(now), dirty))
            dirty, last = 0, now
            if daily:
                full = now

        def until(now: float) -> None:
            """Polls without changes, up to but not at ``now``."""
            while True:
                due = full + DAILY
                if dirty > 0:
                    due = min(due, last + INTERVAL)
                at = started + POLL * -(-(due - started) // POLL)
                if at >= now:
                    return
                fire(max(at, poll + POLL))

        poll = float(started)
        for tick, changes in pdf.sort_values("tick")[["tick", "changes"]].itertuples(index=False):
            now = (tick + 1) * POLL
            if now <= started:
                continue
            until(now)
            dirty += int(changes)
            if should_rebuild(dirty, now - last, now - full):
                fire(now)
            poll = now
        return pd.DataFrame(out, columns=["root", "rebuilt_at", "dirty"])

    return counted.groupBy("root").applyInPandas(fold, f"root {dict(counted.dtypes)['root']}, rebuilt_at bigint, dirty bigint")
