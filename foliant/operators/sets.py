"""Set operations on posting lists, joins by folder, and other operators over entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import join_path
from .search import rank_rows


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    """Ids in both: (entry_id)."""
    return a.select("entry_id").distinct().join(b.select("entry_id"), "entry_id", "left_semi")


def merge(a: DataFrame, b: DataFrame) -> DataFrame:
    """Ids in either, once each."""
    return a.select("entry_id").union(b.select("entry_id")).distinct()


def complement(all_ids: DataFrame, a: DataFrame) -> DataFrame:
    return all_ids.select("entry_id").join(a.select("entry_id"), "entry_id", "left_anti")


def contains(ids: Column, entry_id: int) -> Column:
    """Whether a sorted list of ids has one."""
    return F.array_contains(ids, F.lit(entry_id))


def union_shards(*shards: DataFrame) -> DataFrame:
    """All rows of all shards."""
    out = shards[0]
    for s in shards[1:]:
        out = out.unionByName(s)
    return out


def with_directory(entries: DataFrame, dirs: DataFrame) -> DataFrame:
    """Each entry with its folder's row."""
    return entries.join(dirs, "dir_path")


def find_directory(dirs: DataFrame, path: str) -> DataFrame:
    """The folder's row, or none."""
    return dirs.where(F.col("dir_path") == path)


def subtree_entries(entries: DataFrame, tree: DataFrame, scope: str) -> DataFrame:
    """Entries in or below a folder: those whose folder's number lies in the scope's range.

    tree: (dir_path, first, last), of which one row is read; the range of whole numbers that it
    gives reaches the files' statistics. A scope that holds nothing gives no rows.
    """
    found = tree.where(F.col("dir_path") == scope).select("first", "last").head()
    return entries.limit(0) if found is None else entries.where(F.col("folder").between(found.first, found.last))


def with_folder_color(rows: DataFrame, colors: DataFrame) -> DataFrame:
    """Each row with its folder's color, null without one. colors: (path, color)."""
    return rows.withColumn("path", join_path(F.col("dir_path"), F.col("name"))).join(colors, "path", "left")


#: Ids in one block, and bytes in one, of a folder: what a window or a join key holds at most.
ID_BLOCK, BYTE_BLOCK = 1 << 16, 1 << 8


def name_offsets(entries: DataFrame) -> DataFrame:
    """Each name's place in its folder's blob of names, end to end in entry order: (dir_path, entry_id, name, start, size).

    A folder may hold any number of entries: sums run inside blocks of ids, and over
    the blocks' totals, a row for each 65,536 ids.
    """
    rows = entries.select("dir_path", F.floor(F.col("entry_id") / ID_BLOCK).alias("block"), "entry_id", "name", F.octet_length("name").cast("long").alias("size"))
    blocks = rows.groupBy("dir_path", "block").agg(F.sum("size").alias("bytes"))
    blocks = blocks.select("dir_path", "block", F.coalesce(F.sum("bytes").over(Window.partitionBy("dir_path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    inside = F.coalesce(F.sum("size").over(Window.partitionBy("dir_path", "block").orderBy("entry_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("inside", inside).join(blocks, ["dir_path", "block"]).select("dir_path", "entry_id", "name", (F.col("base") + F.col("inside")).alias("start"), "size")


def floor_lookup(positions: DataFrame, offsets: DataFrame) -> DataFrame:
    """As-of: the entry whose name holds each position of a folder's blob, none past its end.

    A name lies in one or two blocks of bytes, so it meets the positions of the same
    blocks in a join by key; no window, no range join. positions: (dir_path, pos).
    """
    block = lambda at: F.floor(at / BYTE_BLOCK)
    names = offsets.where("size > 0").select("dir_path", "entry_id", "start", "size", F.explode(F.sequence(block(F.col("start")), block(F.col("start") + F.col("size") - 1))).alias("block"))
    asked = positions.select("dir_path", "pos", block(F.col("pos")).alias("block"))
    return asked.join(names, ["dir_path", "block"]).where("start <= pos and pos < start + size").select("dir_path", "pos", "entry_id")


def suppress_repeats(rows: DataFrame, within: str = "dir_path", order: str = "entry_id", value: str = "category") -> DataFrame:
    """Rows whose value differs from that of the row before, in the order of a whole number.

    Blocks of that number are looked through on their own; a block's first row is held
    against the last value of the block before.
    """
    held = F.struct(F.col(value).alias("value"))  # a null value is a value
    rows = rows.withColumn("__block", F.floor(F.col(order) / ID_BLOCK))
    last = rows.groupBy(within, "__block").agg(F.max_by(held, order).alias("__last"))
    before = last.select(within, "__block", F.lag("__last").over(Window.partitionBy(within).orderBy("__block")).alias("__before"))
    was = F.coalesce(F.lag(held).over(Window.partitionBy(within, "__block").orderBy(order)), F.col("__before"))
    return rows.join(before, [within, "__block"]).withColumn("__was", was).where(F.col("__was").isNull() | ~F.col("__was.value").eqNullSafe(F.col(value))).drop("__was", "__before", "__block").select(*(c for c in rows.columns if c != "__block"))


def lengths_from_offsets(offsets: DataFrame) -> DataFrame:
    """Each name's length, null for a folder's last entry, which has no offset behind it: (dir_path, entry_id, length)."""
    last = offsets.groupBy("dir_path").agg(F.max("entry_id").alias("last"))
    return offsets.join(last, "dir_path").select("dir_path", "entry_id", F.when(F.col("entry_id") < F.col("last"), F.col("size")).alias("length"))


#: What is tried, in order.
TERMINALS = ("iTerm", "Ghostty", "WezTerm", "kitty", "Alacritty", "Terminal")


def terminals(configured: Column, defaults: tuple[str, ...] = TERMINALS) -> Column:
    """Candidates in order, the configured one in front, none twice."""
    rest = F.array(*map(F.lit, defaults))
    return F.array_distinct(F.when(F.coalesce(configured, F.lit("")) != "", F.array_prepend(rest, configured)).otherwise(rest))


def sample_statistics(rows: DataFrame, by: str, value: str) -> DataFrame:
    """Median (the upper one of an even number), least and most of samples; nulls are no samples.

    Samples get their rank over all groups by ranges (see rank_rows); the median's is
    known from the group's first rank and count. No task holds a group.
    """
    ranked = rank_rows(rows.select(by, value).where(F.col(value).isNotNull()), [F.col(by), F.col(value)])
    per = ranked.groupBy(by).agg((F.min("rank") + F.floor(F.count("*") / 2)).alias("rank"), F.min(value).alias("least"), F.max(value).alias("most"))
    return per.join(ranked.select("rank", F.col(value).alias("median")), "rank").select(by, "median", "least", "most")
