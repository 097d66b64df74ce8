"""Aggregates over the folder hierarchy."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import counted_extension, join_path, last_dot
from ..schema import DIRECTORY, EXTS_KEPT
from .search import rank_rows
from .tree import folder_sizes, subtree_totals

__all__ = ["directories", "extension_breakdown", "folder_sizes", "histogram", "numbered", "posting_lists", "scope_totals", "with_folder_sizes"]


def directories(entries: DataFrame) -> DataFrame:
    """(dir_path, local_bytes, first_entry_id): each folder that entries lie in, sizes of those that aren't folders."""
    return entries.groupBy("dir_path").agg(F.sum(F.when(F.col("kind") != DIRECTORY, F.col("size")).otherwise(0)).alias("local_bytes"), F.min("entry_id").alias("first_entry_id"))


def with_folder_sizes(entries: DataFrame, sizes: DataFrame) -> DataFrame:
    """Folders' own entries get the total of the folder that they name, or 0; what was scanned for them is dropped."""
    path = join_path(F.col("dir_path"), F.col("name"))
    folders = entries.where(F.col("kind") == DIRECTORY).withColumn("path", path).join(sizes.select(F.col("dir_path").alias("path"), "total_bytes"), "path", "left").withColumn("size", F.coalesce("total_bytes", F.lit(0)).cast("long"))
    return entries.where(F.col("kind") != DIRECTORY).unionByName(folders.select(*entries.columns))


def histogram(entries: DataFrame) -> DataFrame:
    """(dir_path, category, cnt) of all kinds of entries."""
    return entries.groupBy("dir_path", "category").agg(F.count("*").alias("cnt"))


def extension_breakdown(entries: DataFrame) -> DataFrame:
    """The 32 most frequent extensions of each folder and category; ties in order of entries."""
    counts = [F.sum("cnt").alias("cnt"), F.min("first_entry_id").alias("first_entry_id")]
    spelt = entries.groupBy("dir_path", "category", last_dot(F.col("name")).alias("behind")).agg(F.count("*").alias("cnt"), F.min("entry_id").alias("first_entry_id"))
    # folded once for each spelling in a folder; those that aren't counted rank last, as a filter before would fold every name
    counted = spelt.select("dir_path", "category", counted_extension(F.col("behind")).alias("ext"), "cnt", "first_entry_id").groupBy("dir_path", "category", "ext").agg(*counts)
    rank = F.row_number().over(Window.partitionBy("dir_path", "category").orderBy(F.isnull("ext"), F.desc("cnt"), "first_entry_id"))
    return counted.withColumn("rn", rank).where((F.col("rn") <= EXTS_KEPT) & F.col("ext").isNotNull())


def numbered(dirs: DataFrame) -> DataFrame:
    """``dirs`` with ``folder``: numbers from 1 in an order in which each subtree is a range of them."""
    return rank_rows(dirs, [(F.split("dir_path", "/", -1), True)], "folder")


#: The category of rows that count folders, in what ``scope_totals`` sums up.
FOLDERS = -1


def scope_totals(dirs: DataFrame, histogram: DataFrame, breakdown: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What a scope needs, for each folder and all that lie above one: (dir_path, first, last), the
    range of folder numbers of its subtree; (dir_path, category, cnt); (dir_path, category, ext, cnt, rn), the
    32 most frequent of the added lists, ties by name.

    All three go up the tree in one roll-up. Lists are added whole and cut at the end.
    """
    none = F.lit(None).cast("long")
    rows = dirs.select("dir_path", F.lit(FOLDERS).alias("category"), F.lit(None).cast("string").alias("ext"), F.lit(1).cast("long").alias("cnt"), F.col("folder").alias("first"), F.col("folder").alias("last"))
    rows = rows.unionByName(histogram.select("dir_path", "category", F.lit(None).cast("string").alias("ext"), "cnt", none.alias("first"), none.alias("last")))
    rows = rows.unionByName(breakdown.select("dir_path", "category", "ext", "cnt", none.alias("first"), none.alias("last")))
    all_ = subtree_totals(rows, ["category", "ext"], {"cnt": F.sum("cnt"), "first": F.min("first"), "last": F.max("last")})
    counts = all_.where(F.col("ext").isNull() & (F.col("category") != FOLDERS)).select("dir_path", "category", "cnt")
    rank = F.row_number().over(Window.partitionBy("dir_path", "category").orderBy(F.desc("cnt"), "ext"))
    exts = all_.where("ext is not null").select("dir_path", "category", "ext", "cnt", rank.alias("rn")).where(F.col("rn") <= EXTS_KEPT)
    return all_.where(F.col("category") == FOLDERS).select("dir_path", "first", "last"), counts, exts


def posting_lists(entries: DataFrame, block: int = 1 << 16) -> DataFrame:
    """(category, block, ids, cnt): sorted entry ids of each category, cut into blocks by id so no list is unbounded."""
    return entries.groupBy("category", F.floor(F.col("entry_id") / block).alias("block")).agg(F.array_sort(F.collect_list("entry_id")).alias("ids"), F.count("*").alias("cnt"))
