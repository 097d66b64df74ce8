"""File-system scans, and the rules of what is left out. The tree has to be mounted on the executors.

``scan`` goes in rounds: the folders still to be listed are a table, dealt out to a
fixed number of tasks; each lists its own, goes on below them for a while, and gives
back the folders that it didn't come to. The driver lists nothing. A root of a
million folders is spread over all tasks in the second round, a deep chain is
walked in few rounds, and a lost executor costs the round at hand.

The same as a data source, read when it is used:
``spark.dataSource.register(FileTreeSource)``, then
``spark.read.format("filetree").option("root", "/data").load()``. The driver lists
folders, level by level from the root, until it has at least ``splits`` (default 256)
subtrees; each is a partition that a task walks on its own, and the folders above
them are listed by tasks as well.
"""

from __future__ import annotations

import os
import stat
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.names import join_path, with_category
from ..schema import DIRECTORY, FILE, SYMLINK
from .shared import fresh_path, passing

# Names and path ends that are not scanned.
EXCLUDED_NAMES = (".git", "node_modules", ".Trash", "__pycache__", ".DS_Store", ".cache", ".npm", ".yarn", ".Spotlight-V100", ".fseventsd")
EXCLUDED_PATHS = ("Library/Caches", "Library/Logs", "Library/Developer")
#: Bytes of a path; folders beyond are skipped with all below.
MAX_PATH = 4096
#: Folders that a task lists below its own in one round, and rows that it hands on at a time.
BUDGET, ROWS = 4096, 8192
SCHEMA = "name string, dir_path string, size bigint, mtime bigint, kind int"


def excluded_name(name: Column) -> Column:
    return name.isin(*EXCLUDED_NAMES)


def excluded_path(path: Column) -> Column:
    return path.rlike(f"(^|/)({'|'.join(EXCLUDED_PATHS)})$")


def is_excluded(name: Column, path: Column, kind: Column) -> Column:
    """What the scan drops itself: excluded and dot names of any kind, excluded and over-long paths of folders."""
    return excluded_name(name) | name.startswith(".") | ((kind == DIRECTORY) & (excluded_path(path) | (F.octet_length(path) > MAX_PATH)))


def without_excluded(entries: DataFrame) -> DataFrame:
    """Entries that a scan gives: those excluded go, with all that lies below an excluded folder.

    That a folder lies below one is seen from its own path, part by part, so no
    entry is held against another.
    """
    path = join_path(F.col("dir_path"), F.col("name"))
    parts = F.filter(F.split("dir_path", "/"), lambda p: p != "")
    above = F.exists(parts, lambda p: excluded_name(p) | p.startswith("."))
    within = F.col("dir_path").rlike(f"(^|/)({'|'.join(EXCLUDED_PATHS)})(/|$)") | (F.octet_length("dir_path") > MAX_PATH)
    return entries.where(~is_excluded(F.col("name"), path, F.col("kind")) & ~above & ~within)


def skips(name: str, path: str, folder: bool) -> bool:
    return name in EXCLUDED_NAMES or name.startswith(".") or (folder and (any(path == p or path.endswith("/" + p) for p in EXCLUDED_PATHS) or len(os.fsencode(path)) > MAX_PATH))


def kind_of(mode: int) -> int:
    return DIRECTORY if stat.S_ISDIR(mode) else SYMLINK if stat.S_ISLNK(mode) else FILE


def scan_one(folder: str):
    """Rows of one folder and its subfolders that are to be scanned."""
    with os.scandir(folder) as found:
        for item in found:
            path = f"{folder.rstrip('/')}/{item.name}"
            is_dir = item.is_dir(follow_symlinks=False)
            if skips(item.name, path, is_dir):
                continue
            s = item.stat(follow_symlinks=False)
            yield (item.name, folder, getattr(s, "st_blocks", 0) * 512, int(s.st_mtime // 1), kind_of(s.st_mode)), path if is_dir else None


class Subtree(InputPartition):
    def __init__(self, folder: str, deep: bool) -> None:
        self.folder, self.deep = folder, deep


class FileTreeReader(DataSourceReader):
    def __init__(self, root: str, splits: int) -> None:
        self.root, self.splits = root, splits

    def partitions(self) -> list[InputPartition]:
        above, below = [], [self.root]
        while below and len(below) < self.splits:
            above += below
            below = [path for folder in below for _, path in scan_one(folder) if path]
        return [*(Subtree(p, False) for p in above), *(Subtree(p, True) for p in below)]

    def read(self, partition: Subtree):
        left = [partition.folder]
        while left:  # an unreadable folder fails the scan: no snapshot is made of half a tree
            for row, path in scan_one(left.pop()):
                yield row
                if path and partition.deep:
                    left.append(path)


class FileTreeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "filetree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FileTreeReader:
        return FileTreeReader(os.path.normpath(self.options["root"]), int(self.options.get("splits", 256)))


def _listed(batches: Iterator[pa.RecordBatch], budget: int) -> Iterator[pa.RecordBatch]:
    """Entries of the folders given and of up to ``budget`` below them; folders that are left come as ``todo``."""
    rows: list[tuple] = []

    def hand_on() -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True))
        rows.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string()), strict=True)], ["name", "dir_path", "size", "mtime", "kind", "todo"])

    left: list[str] = []
    for batch in batches:
        for folder in batch.column("todo").to_pylist():
            for row, path in scan_one(folder):  # an unreadable folder fails the scan: no snapshot is made of half a tree
                rows.append((*row, None))
                if path:
                    left.append(path)
                if len(rows) >= ROWS:
                    yield hand_on()
    while left and budget > 0:
        budget -= 1
        for row, path in scan_one(left.pop()):
            rows.append((*row, None))
            if path:
                left.append(path)
            if len(rows) >= ROWS:
                yield hand_on()
    for path in left:
        rows.append((None, None, None, None, None, path))
        if len(rows) >= ROWS:
            yield hand_on()
    if rows:
        yield hand_on()


def scan(spark: SparkSession, root: str, partitions: int | None = None, budget: int = BUDGET) -> DataFrame:
    """(name, dir_path, size, mtime, kind, category) of a tree as it is now; size as allocated on disk, folders are category 0."""
    n = partitions or 4 * spark.sparkContext.defaultParallelism
    at, schema, k = fresh_path(spark, "scan"), f"{SCHEMA}, todo string", 0
    todo = spark.createDataFrame([(os.path.normpath(root),)], "todo string")
    while True:
        todo.repartition(n if k else 1).mapInArrow(lambda batches: _listed(batches, budget), schema).write.parquet(f"{at}/{k}")
        held = spark.read.schema(schema).parquet(f"{at}/{k}")
        todo, k = held.where("todo is not null").select("todo"), k + 1
        if not todo.head(1):
            break
    passing(spark, at)
    rows = spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(at).where("name is not null").drop("todo")
    return with_category(rows)
