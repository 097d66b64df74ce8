"""A stream of changes from logs: a Python data source with offsets.

Collectors append lines ``seconds <tab> change <tab> path`` (escaped as in shards, seconds
since the epoch with a fraction) to files ``*.log`` in one folder, each file in order of time.

    spark.dataSource.register(ChangeLogSource)
    spark.readStream.format("changelog").option("folder", ...).option("exclude", ...).load()

An offset is a position in each file, so a batch that is delivered again has the same
rows, none lost and none doubled. Changes are handed on once their window of WINDOW
seconds is over: a log's window never straddles two batches, and a chunk gives one row
for each path and window; ``coalesced`` does so for a whole batch. A log that comes late, with
old times, is delivered like any other. The driver finds positions by bisection and reads no more.
"""

from __future__ import annotations

import os
import time
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

# Seconds in which changes of one path are one, and how many paths can be left out.
WINDOW, MOST_EXCLUDED = 2.0, 8
SCHEMA = "path string, change string, at timestamp"
#: Bytes of a log that one task reads.
CHUNK = 8 << 20


def line_of(seconds: float, change: str, path: str) -> bytes:
    """A log's line."""
    plain = path.replace("\\", "\\\\").replace("\t", "\\t").replace("\n", "\\n")
    return f"{seconds:.3f}\t{change}\t{plain}\n".encode()


def _unescaped(text: str) -> str:
    codes = {"\\": "\\", "t": "\t", "n": "\n"}
    parts = text.split("\\\\")
    return "\\".join(p.replace("\\t", codes["t"]).replace("\\n", codes["n"]) for p in parts)


def _line_at(f, place: int) -> tuple[int, bytes]:
    """The first whole line that begins at ``place`` or behind it: where, and what."""
    f.seek(max(0, place - 1))
    if place and f.read(1) != b"\n":
        f.readline()
    begin = f.tell()
    return begin, f.readline()


def position(path: str, start: int, before: float) -> int:
    """Where the first line of that time or later begins, not before ``start``; a line without an end isn't there yet."""
    with open(path, "rb") as f:
        low, high = start, os.fstat(f.fileno()).st_size
        found = start  # all lines in front of it are older
        while low < high:
            middle = (low + high) // 2
            begin, line = _line_at(f, middle)
            if begin >= high or not line.endswith(b"\n") or float(line.split(b"\t", 1)[0]) >= before:
                high = middle
            else:
                found = low = begin + len(line)
        return found


class Chunk(InputPartition):
    def __init__(self, path: str, begin: int, end: int) -> None:
        self.path, self.begin, self.end = path, begin, end


class ChangeLogReader(DataSourceStreamReader):
    def __init__(self, folder: str, exclude: list[str], settle: float) -> None:
        self.folder, self.exclude, self.settle = folder, exclude, settle
        self.last: dict[str, int] = {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        over = (time.time() - self.settle) // WINDOW * WINDOW
        for name in sorted(n for n in os.listdir(self.folder) if n.endswith(".log")):
            self.last[name] = position(f"{self.folder}/{name}", self.last.get(name, 0), over)
        return {name: at for name, at in self.last.items() if at}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        for name, at in end.items():  # after a restart go on from there
            self.last[name] = max(at, self.last.get(name, 0))
        return [Chunk(f"{self.folder}/{name}", k, min(k + CHUNK, at)) for name, at in sorted(end.items()) for k in range(start.get(name, 0), at, CHUNK)]

    def read(self, partition: Chunk) -> Iterator[tuple]:
        """Lines that begin in the chunk; of one path and window the last."""
        held: dict[tuple[str, float], str] = {}
        with open(partition.path, "rb") as f:
            place, line = _line_at(f, partition.begin)
            while line and place < partition.end:
                seconds, change, path = line[:-1].decode().split("\t", 2)
                held[_unescaped(path), float(seconds) // WINDOW * WINDOW] = change
                place, line = place + len(line), f.readline()
        for (path, window), change in held.items():
            if not any(path == e or path.startswith(e + "/") for e in self.exclude):
                yield path, change, _timestamp(window)

    def commit(self, end: dict) -> None:
        """Logs stay; who writes them deletes them."""


def _timestamp(seconds: float):
    from datetime import UTC, datetime

    return datetime.fromtimestamp(seconds, UTC)


class ChangeLogSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "changelog"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> ChangeLogReader:
        exclude = [e for e in self.options.get("exclude", "").split("\n") if e]
        if len(exclude) > MOST_EXCLUDED:
            raise ValueError(f"over {MOST_EXCLUDED} paths to leave out")
        return ChangeLogReader(self.options["folder"], exclude, float(self.options.get("settle", WINDOW)))


def changes(spark: SparkSession, folder: str, exclude: tuple[str, ...] = (), settle: float = WINDOW) -> DataFrame:
    """The stream of (path, change, at): when its window began.

    settle: how many seconds collectors may be late. exclude: at most eight paths, which go with all below
    them; give the catalog's own folder too.
    """
    spark.dataSource.register(ChangeLogSource)
    return spark.readStream.format("changelog").option("folder", folder).option("exclude", "\n".join(exclude)).option("settle", settle).load()


def coalesced(batch: DataFrame) -> DataFrame:
    """A micro-batch with one row for each path and window, whatever logs and chunks it comes from."""
    return batch.dropDuplicates(["path", "at"])
