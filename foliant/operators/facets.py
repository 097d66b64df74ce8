"""Facets, answered from the stored aggregates and not from entries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import CATEGORIES, EXTS_KEPT, MAX_DEPTH


def _scoped(df: DataFrame, scope: str, max_depth: int) -> DataFrame:
    """A slash at the end is kept here, unlike in queries: such a scope matches nothing."""
    if max_depth == 1:
        return df.where(F.col("dir_path") == scope)
    return df if scope == "/" else df.where((F.col("dir_path") == scope) | F.col("dir_path").startswith(scope + "/"))


def all_categories(spark: SparkSession) -> DataFrame:
    return spark.range(CATEGORIES).select(F.col("id").cast("int").alias("category"))


def histogram(stored: DataFrame, scope: str = "/", max_depth: int = MAX_DEPTH, totals: DataFrame | None = None) -> DataFrame:
    """(category, cnt), nine rows, zeros included. totals: sums of subtrees, of which a scope reads its own rows alone."""
    rows = _scoped(stored, scope or "/", max_depth) if totals is None or max_depth == 1 else _scoped(totals, scope or "/", 1)
    found = rows.groupBy("category").agg(F.sum("cnt").alias("cnt"))
    return all_categories(stored.sparkSession).join(found, "category", "left").select("category", F.coalesce("cnt", F.lit(0)).cast("long").alias("cnt"))


def extension_breakdown(stored: DataFrame, scope: str, max_depth: int, category: int, max_rows: int = EXTS_KEPT, totals: DataFrame | None = None) -> DataFrame:
    """(ext, cnt, rn): depth 1 is the stored list's head; else lists are added up, ties by name, or read from ``totals``, where they are added up already."""
    most = min(max_rows, EXTS_KEPT)
    ready = totals is not None and max_depth != 1
    rows = (_scoped(totals, scope or "/", 1) if ready else _scoped(stored, scope or "/", max_depth)).where(F.col("category") == category)
    if category >= CATEGORIES or most <= 0:
        rows = rows.limit(0)
    if max_depth == 1 or ready:
        return rows.where(F.col("rn") <= most).select("ext", F.col("cnt").cast("long").alias("cnt"), F.col("rn").cast("int").alias("rn"))
    added = rows.groupBy("ext").agg(F.sum("cnt").alias("cnt")).orderBy(F.desc("cnt"), "ext").limit(most)
    return _ranked(added)


def _ranked(top: DataFrame) -> DataFrame:
    """Number at most 32 rows."""
    from pyspark.sql import Window

    return top.select("ext", "cnt", F.row_number().over(Window.orderBy(F.desc("cnt"), "ext")).alias("rn"))


def facet_model(hist: DataFrame, breakdown: DataFrame, scope: str = "/", max_depth: int = MAX_DEPTH, exts: int = 16, totals: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """(category, cnt, rank, extensions): what a sidebar shows, in one query.

    totals: histogram and lists summed over subtrees; with them a scope reads one folder's rows.
    Categories without entries are left out, and Other too unless it is alone.
    """
    from pyspark.sql import Window

    if totals and max_depth != 1 and exts <= EXTS_KEPT:
        hist, breakdown, max_depth, order = *totals, 1, [F.asc("first")]
    else:
        order = [F.asc("first")] if max_depth == 1 else [F.desc("cnt"), F.asc("ext")]
    counts = _scoped(hist, scope, max_depth).groupBy("category").agg(F.sum("cnt").alias("cnt")).where("cnt > 0")
    few = counts.withColumn("n", F.count("*").over(Window.partitionBy(F.lit(1)))).where("category != 0 or n = 1")  # nine rows at most
    ranked = few.select("category", "cnt", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("cnt"), "category")).alias("rank"))
    rows = _scoped(breakdown, scope, max_depth)
    added = rows.groupBy("category", "ext").agg(F.sum("cnt").alias("cnt"), F.min("rn").alias("first"))
    top = added.withColumn("rn", F.row_number().over(Window.partitionBy("category").orderBy(*order))).where(F.col("rn") <= exts)
    lists = top.groupBy("category").agg(F.transform(F.array_sort(F.collect_list(F.struct("rn", "ext", "cnt"))), lambda x: F.concat_ws(":", x.ext, x.cnt.cast("string"))).alias("extensions"))
    return ranked.join(lists, "category", "left").select("category", "cnt", "rank", F.coalesce(F.array_join("extensions", ","), F.lit("")).alias("extensions"))
