"""Catalog snapshots: entries and their aggregates as Parquet, published at once or not at all.

A catalog is a folder with one sub-folder for each snapshot and a pointer file,
CURRENT, that names the newest. A snapshot has

* ``entries``, in files that hold ranges of (category, folder number, entry id),
* ``dirs`` with sizes and numbers of folders, ``tree`` with the range of numbers of each subtree,
* ``histogram`` and ``ext_breakdown`` of folders, ``scope_histogram`` and ``scope_exts`` of whole subtrees,
* ``grams``: which entry files have names with which runs of three characters,
* META, and MANIFEST: each file's size, and of entry files rows, least and greatest id. A snapshot
  with a file lost, cut or added does not open.

Readers hold on to the snapshot they opened by a lease in the store; it is never
changed. A build removes older snapshots that no lease holds, but for the one that it
replaces. Paths may be in any store that Spark's Hadoop file systems reach.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterable
from dataclasses import asdict, dataclass
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.fold import fold, fold_ascii, folded, lower_ascii
from ..operators import rollup
from ..operators.search import CLIENT_CAP, matching, search
from ..plans.query import Category, Query, parse
from ..schema import MAX_DEPTH, OLDEST_VERSION, RAW, SCHEMA_VERSION
from .shared import Run, written


def _schema(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


TEXT, LONG, INT = T.StringType(), T.LongType(), T.IntegerType()
ENTRIES = T.StructType([*RAW, T.StructField("name_folded", TEXT), T.StructField("folder", LONG)])
DIRS = _schema(dir_path=TEXT, local_bytes=LONG, first_entry_id=LONG, total_bytes=LONG, folder=LONG)
TREE = _schema(dir_path=TEXT, first=LONG, last=LONG)
HISTOGRAM = _schema(dir_path=TEXT, category=INT, cnt=LONG)
BREAKDOWN = _schema(dir_path=TEXT, category=INT, ext=TEXT, cnt=LONG, first_entry_id=LONG, rn=INT)
SCOPE_EXTS = _schema(dir_path=TEXT, category=INT, ext=TEXT, cnt=LONG, rn=INT)
GRAMS = _schema(gram=INT, file=INT)
#: Characters of a gram, bits of its hash, rows of an entry file at most.
GRAM, GRAM_BITS, FILE_ROWS = 3, 24, 1_000_000
#: From so many entry files on, a search looks up its grams first, and reads files in order of ids until its cap is reached.
INDEX_FILES, ORDERED_FILES = 64, 64
#: Seconds that a reader's lease counts without being renewed.
LEASE = 24 * 3600.0
_OPEN_TRIES = 3


class CatalogError(RuntimeError):
    """A catalog that can't be read or must not be published."""


class Store:
    """The few file operations that a pointer needs, through Hadoop's file system."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.jvm = spark, spark.sparkContext._jvm
        self.root = root.rstrip("/")
        self.fs = self.path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def read(self, name: str) -> str | None:
        if not self.fs.exists(self.path(name)):
            return None
        stream = self.fs.open(self.path(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def replace(self, name: str, text: str) -> None:
        """Write beside, then rename over: a reader sees the old text or the new."""
        new = self.path(f".{name}.{uuid.uuid4().hex}")
        out = self.fs.create(new, True)
        out.write(bytearray(text.encode()))
        out.hsync()
        out.close()
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.fs.getConf())
        over = getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename").OVERWRITE
        options = self.spark.sparkContext._gateway.new_array(getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename"), 1)
        options[0] = over
        context.rename(new, self.path(name), options)

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)

    def names(self, name: str = "") -> list[str]:
        """What lies in a folder; nothing if there is none."""
        at = self.path(name)
        return [f.getPath().getName() for f in self.fs.listStatus(at)] if self.fs.exists(at) else []

    def age(self, name: str, now: float) -> float:
        return now - self.fs.getFileStatus(self.path(name)).getModificationTime() / 1000

    def touch(self, name: str, now: float) -> None:
        """Make an empty file, or give it a new time; it goes when the driver ends."""
        at = self.path(name)
        self.fs.create(at, True).close()
        self.fs.deleteOnExit(at)

    def files(self) -> dict[str, int]:
        """Sizes of all Parquet files below, by their paths from here."""
        found, base = {}, self.fs.makeQualified(self.path("")).toUri().getPath()
        each = self.fs.listFiles(self.path(""), True)
        while each.hasNext():
            f = each.next()
            path = f.getPath().toUri().getPath()
            if path.endswith(".parquet") and not f.getPath().getName().startswith(("_", ".")):
                found[path[len(base) + 1 :]] = f.getLen()
        return found

    def forget(self) -> None:
        """Delete the whole folder when the driver ends."""
        self.fs.deleteOnExit(self.path(""))


@dataclass(frozen=True)
class Identity:
    snapshot: str
    entry_count: int
    created: int


@dataclass(frozen=True)
class File:
    """A file of a snapshot as its manifest has it; rows and ids are those of entry files."""

    path: str
    bytes: int
    rows: int | None = None
    first: int | None = None
    last: int | None = None

    @property
    def category(self) -> int:
        return int(self.path.split("category=")[1].split("/")[0])


def build(entries: DataFrame, root: str, expected: int | None = None, created: int = 0, version: int = SCHEMA_VERSION, clock: Callable[[], float] = time.time) -> Identity:
    """Write a snapshot of scanned ``entries`` (RAW columns) and publish it.

    The source is read once: what it gave is written first and all else is made of
    that, so a tree that changes meanwhile gives one consistent snapshot. Nothing is
    published, and nothing stays, if the rows written aren't as many as the scan gave, or
    not ``expected`` in number, or if anything fails on the way.
    """
    spark = entries.sparkSession
    store, name = Store(spark, root), f"snapshot-{uuid.uuid4().hex}"
    try:
        with Run(spark) as mine:
            n = _write(entries, f"{store.root}/{name}", expected, version)
            mine.drop()
        store.delete(f"{name}/scanned")
        at = Store(spark, f"{store.root}/{name}")
        at.replace("MANIFEST", "".join(f"{json.dumps(asdict(f))}\n" for f in _manifest(spark, at)))
        at.replace("META", json.dumps({"schema_version": version, "entry_count": n, "created": created, "snapshot": name}, sort_keys=True))
    except BaseException:
        store.delete(name)
        raise
    replaced = (store.read("CURRENT") or "").strip()
    store.replace("CURRENT", name)
    remove_free(store, {name, replaced}, clock())
    return Identity(name, n, created)


def _write(entries: DataFrame, at: str, expected: int | None, version: int) -> int:
    spark = entries.sparkSession
    scanned = Observation()
    entries.select(*(F.col(f.name).cast(f.dataType) for f in RAW)).observe(scanned, F.count(F.lit(1)).alias("n")).write.parquet(f"{at}/scanned")
    seen = scanned.get["n"]
    entries = spark.read.schema(RAW).parquet(f"{at}/scanned")
    dirs = written(rollup.directories(entries), "dirs")
    sizes = rollup.folder_sizes(dirs)
    rollup.numbered(dirs.join(sizes, "dir_path", "left")).select(*DIRS.names).write.parquet(f"{at}/dirs")
    sizes = spark.read.schema(DIRS).parquet(f"{at}/dirs")
    fold = folded if version >= 7 else lower_ascii
    # a file holds a range of folder numbers: statistics leave few files to a listing or a scope
    keys = ["category", "folder", "entry_id"]
    sized = rollup.with_folder_sizes(entries, sizes).join(sizes.select("dir_path", "folder"), "dir_path")
    # names are folded behind the exchange, whose sample would fold them a second time
    laid = sized.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("name_folded", fold(F.col("name")))
    laid.select(*ENTRIES.names).write.option("maxRecordsPerFile", FILE_ROWS).partitionBy("category").parquet(f"{at}/entries")
    held = spark.read.schema(ENTRIES).parquet(f"{at}/entries")
    n = held.count()
    if n != seen or (expected is not None and n != expected):
        raise CatalogError(f"{n} entries written, {seen if expected is None else expected} expected: not published")
    laid_out = lambda df, part, *by: df.repartitionByRange(*by).sortWithinPartitions(*by).write.parquet(f"{at}/{part}")
    laid_out(rollup.histogram(held), "histogram", "dir_path")
    laid_out(rollup.extension_breakdown(held).select(*BREAKDOWN.names), "ext_breakdown", "dir_path")
    read = lambda part, schema: spark.read.schema(schema).parquet(f"{at}/{part}")
    tree, counts, exts = rollup.scope_totals(sizes, read("histogram", HISTOGRAM), read("ext_breakdown", BREAKDOWN))
    for part, df, schema in (("tree", tree, TREE), ("scope_histogram", counts, HISTOGRAM), ("scope_exts", exts, SCOPE_EXTS)):
        laid_out(df.select(*(F.col(f.name).cast(f.dataType) for f in schema)), part, "dir_path")
    laid_out(_grams(held, Store(spark, at)), "grams", "gram", "file")
    return n


def _entry_files(files: Iterable[str]) -> list[str]:
    return sorted(f for f in files if f.startswith("entries/"))


def _grams(entries: DataFrame, at: Store) -> DataFrame:
    """(gram, file): the hashed runs of GRAM characters in the folded names of each entry file, files by number."""
    numbers = entries.sparkSession.createDataFrame([(*_partition(f), k) for k, f in enumerate(_entry_files(at.files()))], "of int, file_name string, file int")
    # files of one task have one name in all categories; the number, short to compare, is known before names are cut
    named = entries.where(F.length("name_folded") >= GRAM).select("category", F.col("_metadata.file_name").alias("found_in"), "name_folded")
    named = named.join(F.broadcast(numbers), F.col("category").eqNullSafe(F.col("of")) & (F.col("found_in") == F.col("file_name")))
    runs = named.select("file", "name_folded", F.explode(F.sequence(F.lit(1), F.length("name_folded") - (GRAM - 1))).alias("at"))
    gram = F.pmod(F.xxhash64(F.substr("name_folded", F.col("at"), F.lit(GRAM))), F.lit(1 << GRAM_BITS)).cast("int")
    return runs.select(gram.alias("gram"), "file").distinct()


def _partition(path: str) -> tuple[int | None, str]:
    """Category and name of an entry file."""
    _, category, name = path.split("/")
    value = category.removeprefix("category=")
    return int(value) if value.isdigit() else None, name


def gram_hashes(text: str) -> set[int]:
    """Of a folded text, as the table has them."""
    from xxhash import xxh64_intdigest

    return {xxh64_intdigest(text[k : k + GRAM].encode(), 42) & ((1 << GRAM_BITS) - 1) for k in range(len(text) - GRAM + 1)}


def _manifest(spark: SparkSession, at: Store) -> list[File]:
    rows = spark.read.schema(ENTRIES).parquet(f"{at.root}/entries").groupBy(F.concat_ws("/", F.lit("entries"), F.concat(F.lit("category="), F.col("category")), F.col("_metadata.file_name")).alias("path"))
    known = {r.path: (r.n, r.first_id, r.last_id) for r in rows.agg(F.count(F.lit(1)).alias("n"), F.min("entry_id").alias("first_id"), F.max("entry_id").alias("last_id")).collect()}
    return [File(path, size, *known.get(path, ())) for path, size in sorted(at.files().items()) if not path.startswith("scanned/")]


def remove_free(store: Store, keep: set[str], now: float) -> list[str]:
    """Delete snapshots that are not to be kept and that no reader holds; returns which."""
    gone = []
    for name in store.names():
        if not name.startswith("snapshot-") or name in keep or any(store.age(f"leases/{name}/{x}", now) < LEASE for x in store.names(f"leases/{name}")):
            continue
        if "META" in store.names(name) or store.age(name, now) > LEASE:  # else another build may be at work
            store.delete(name)
            store.delete(f"leases/{name}")
            gone.append(name)
    return gone


class Catalog:
    """An open snapshot. With ``poll``, a query first looks for a newer one if the last look is so many seconds ago.

    It holds its snapshot by a lease until ``close``, ``refresh`` or the driver's end, unless ``hold`` is false.
    """

    def __init__(self, spark: SparkSession, root: str, poll: float | None = None, clock: Callable[[], float] = time.monotonic, hold: bool = True, index_files: int = INDEX_FILES, ordered_files: int = ORDERED_FILES) -> None:
        self.spark, self.root, self.poll, self.clock, self.hold = spark, root.rstrip("/"), poll, clock, hold
        self.index_files, self.ordered_files = index_files, ordered_files
        self.lease: str | None = None
        self.opened: list[File] = []  # entry files that the last query read, or will read
        self._open()

    def _open(self) -> None:
        self.looked = self.clock()
        store = Store(self.spark, self.root)
        for k in range(_OPEN_TRIES):  # a snapshot may go between the look and the lease
            name = (store.read("CURRENT") or "").strip()
            if not name:
                raise CatalogError(f"no catalog at {self.root}")
            before, self.lease = self.lease, f"leases/{name}/{uuid.uuid4().hex}" if self.hold else None
            if self.lease:
                store.touch(self.lease, time.time())
            if before:
                store.delete(before)
            self.leased = self.clock()
            if store.fs.exists(store.path(name)) or k == _OPEN_TRIES - 1:
                break
        self.at = f"{self.root}/{name}"
        at = Store(self.spark, self.at)
        meta = json.loads(at.read("META") or "{}")
        self.version = meta.get("schema_version", 0)
        if not OLDEST_VERSION <= self.version <= SCHEMA_VERSION:
            raise CatalogError(f"schema version {self.version} can't be read")
        self.identity = Identity(name, meta["entry_count"], meta["created"])
        self.files = self._checked(at)
        read = lambda part, schema: self.spark.read.schema(schema).parquet(f"{self.at}/{part}")
        self.entries, self.dirs, self.tree = read("entries", ENTRIES), read("dirs", DIRS), read("tree", TREE)
        self.histogram, self.ext_breakdown = read("histogram", HISTOGRAM), read("ext_breakdown", BREAKDOWN)
        self.scope_histogram, self.scope_exts = read("scope_histogram", HISTOGRAM), read("scope_exts", SCOPE_EXTS)
        self.grams = read("grams", GRAMS)

    def _checked(self, at: Store) -> list[File]:
        """Entry files by number, after all files were held against the manifest."""
        text = at.read("MANIFEST")
        if text is None:
            raise CatalogError(f"{self.at} has no manifest")
        files = [File(**json.loads(line)) for line in text.splitlines()]
        said, there = {f.path: f.bytes for f in files}, at.files()
        for path in sorted(said.keys() | there.keys()):
            if said.get(path) != there.get(path):
                raise CatalogError(f"{self.at}/{path} has {there.get(path)} bytes, {said.get(path)} by the manifest")
        entries = [f for f in files if f.path.startswith("entries/")]
        if sum(f.rows or 0 for f in entries) != self.identity.entry_count:
            raise CatalogError(f"{self.at}: the manifest's rows aren't {self.identity.entry_count}")
        return sorted(entries, key=lambda f: f.path)

    def refresh(self) -> bool:
        """Open the newest snapshot if it isn't this one."""
        self.looked = self.clock()
        if (Store(self.spark, self.root).read("CURRENT") or "").strip() == self.identity.snapshot:
            return False
        self._open()
        return True

    def close(self) -> None:
        """Give the snapshot free; what was read of it so far stays whole only until a build removes it."""
        if self.lease:
            Store(self.spark, self.root).delete(self.lease)
            self.lease = None

    def count(self) -> int:
        return self.identity.entry_count

    def read(self, files: list[File]) -> DataFrame:
        """The entries of some files; none opens no file."""
        if not files:
            return self.spark.createDataFrame([], ENTRIES)
        return self.spark.read.schema(ENTRIES).option("basePath", f"{self.at}/entries").parquet(*(f"{self.at}/{f.path}" for f in files))

    def candidates(self, q: Query) -> list[File]:
        """Entry files that may hold matches: those of the categories asked for, with all grams of the text.

        The text's grams are looked up in the table, one small read whatever the number of entries.
        """
        files, wanted = list(enumerate(self.files)), [c.value for c in q.criteria if isinstance(c, Category) and not c.negated]
        files = [(k, f) for k, f in files if all(f.category == c for c in wanted)]
        text = (fold if self.version >= 7 else fold_ascii)(q.text)
        if len(text) >= GRAM and len(files) >= self.index_files:
            grams = gram_hashes(text)
            found = self.grams.where(reduce(or_, (F.col("gram") == g for g in sorted(grams)))).groupBy("file").count()
            hit = {r.file for r in found.where(F.col("count") == len(grams)).collect()}
            files = [(k, f) for k, f in files if k in hit]
        return [f for _, f in files]

    def query(self, text: str, scope: str = "/", max_depth: int = MAX_DEPTH, max_results: int = CLIENT_CAP, now: int = 0) -> DataFrame:
        if self.poll is not None and self.clock() - self.looked >= self.poll:
            self.refresh()
        if self.lease and self.clock() - self.leased > LEASE / 4:
            Store(self.spark, self.root).touch(self.lease, time.time())
            self.leased = self.clock()
        q = parse(text, now)
        find = lambda rows: matching(rows, q, scope, max_depth, now, self.version)
        if len(self.files) < min(self.index_files, self.ordered_files):
            self.opened, rows = self.files, self.entries
        else:
            self.opened = self.candidates(q)
            if len(self.opened) >= self.ordered_files:
                self.opened, holding = self._in_order(self.opened, find, max_results)
                return search(self.read(holding), q, scope, max_depth, max_results, now, self.version)
            rows = self.read(self.opened)
        return search(rows, q, scope, max_depth, max_results, now, self.version)

    def _in_order(self, files: list[File], find: Callable[[DataFrame], DataFrame], cap: int) -> tuple[list[File], list[File]]:
        """Files opened until the first ``cap`` matches in order of ids are known, and those that hold these.

        Batches of files, by least id, double; it ends when no file left can hold a smaller
        id than the last match. What comes to the driver is ids and file names of ``cap`` rows.
        """
        files = sorted(files, key=lambda f: (f.first, f.path))
        best: list[tuple[int, str]] = []
        start, size = 0, max(1, self.spark.sparkContext.defaultParallelism // 2)
        while start < len(files) and cap > 0:
            batch = files[start : start + size]
            rows = find(self.read(batch)).select("entry_id", F.col("_metadata.file_name").alias("file_name")).orderBy("entry_id").limit(cap).toArrow()
            best = sorted([*best, *zip(rows.column("entry_id").to_pylist(), rows.column("file_name").to_pylist(), strict=True)])[:cap]
            start, size = start + size, 2 * size
            if len(best) == cap and start < len(files) and best[-1][0] < files[start].first:
                break
        names = {name for _, name in best}
        return files[:start], [f for f in files if f.path.split("/")[-1] in names]
