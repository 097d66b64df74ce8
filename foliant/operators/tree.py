"""Roll-ups over the tree of folders, a level at a time from the deepest.

A level is a grouped sum of what the level below hands to its parents; it is written
before the next one is made. So a folder meets as many rows as it has children,
summed up in part before they are sent, and no path is spread over all folders above
it. There are as many rounds as the longest path has names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import parent
from ..sources.shared import Run, fresh_path, passing, written


def level(path: Column) -> Column:
    """How many folders lie above: 0 for the root, 1 for its folders and for paths without a slash, and so on."""
    slashes = F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit("")))
    return F.when(path == "/", 0).when(path.startswith("//"), slashes - 1).when(path.startswith("/"), slashes).otherwise(slashes + 1)


def above(path: Column) -> Column:
    """The folder above; the root for paths without a slash, which a scope of everything holds too."""
    return F.coalesce(parent(path), F.lit("/"))


def _levels(rows: DataFrame) -> tuple[DataFrame, list[int]]:
    """Rows written by level, and the levels there are, the deepest first; a few thousand at most, as paths have no more names."""
    spark, at = rows.sparkSession, fresh_path(rows.sparkSession, "levels")
    leveled = rows.withColumn("level", level(F.col("dir_path")))
    leveled.write.partitionBy("level").parquet(at)
    held = spark.read.schema(leveled.schema).parquet(passing(spark, at))
    return held, sorted((r.level for r in held.select("level").distinct().collect()), reverse=True)


def folder_sizes(dirs: DataFrame) -> DataFrame:
    """(dir_path, total_bytes) over each folder's subtree.

    dirs: (dir_path, local_bytes), a row a folder. A size goes up from folder to folder as
    long as the next one above is itself in ``dirs``; at a gap, and at a path without
    a slash, it stops.
    """
    spark = dirs.sparkSession
    with Run(spark) as mine:
        held, levels = _levels(dirs.select("dir_path", "local_bytes"))
        at, below, out = fresh_path(spark, "sizes"), None, None
        for n in levels:
            total = held.where(F.col("level") == n).select("dir_path", F.col("local_bytes").alias("total_bytes"))
            if below is not None and below[0] == n + 1:
                given = below[1].select(parent(F.col("dir_path")).alias("dir_path"), "total_bytes").where("dir_path is not null")
                given = given.groupBy("dir_path").agg(F.sum("total_bytes").alias("given"))
                total = total.join(given, "dir_path", "left").select("dir_path", (F.col("total_bytes") + F.coalesce("given", F.lit(0))).alias("total_bytes"))
            total.write.parquet(f"{at}/{n}")
            below = n, spark.read.schema(total.schema).parquet(f"{at}/{n}")
        mine.drop()
        if not levels:
            return dirs.select("dir_path", F.col("local_bytes").alias("total_bytes"))
        passing(spark, at)
        out = spark.read.schema(below[1].schema).option("recursiveFileLookup", "true").parquet(at)
    return out


def subtree_totals(rows: DataFrame, keys: list[str], totals: dict[str, Column]) -> DataFrame:
    """(dir_path, *keys, *totals): each folder's totals over all rows in or below it.

    totals: aggregates by the names that they have in ``rows`` too, which may be taken
    again of what they gave (sums, least, most). Gaps don't matter: each folder that lies
    above some row gets its totals, the root those of all.
    """
    spark = rows.sparkSession
    columns = ["dir_path", *keys, *totals]
    with Run(spark) as mine:
        held, levels = _levels(rows.select(*columns))
        if not levels:
            return written(rows.select(*columns), "totals")
        at, below = fresh_path(spark, "totals"), None
        for n in range(levels[0], -1, -1):
            here = held.where(F.col("level") == n).select(*columns)
            if below is not None:
                here = here.unionByName(below.withColumn("dir_path", above(F.col("dir_path"))))
            summed = here.groupBy("dir_path", *keys).agg(*(total.alias(name) for name, total in totals.items()))
            summed.select(*(F.col(f.name).cast(f.dataType) for f in rows.select(*columns).schema)).write.parquet(f"{at}/{n}")
            below = spark.read.schema(rows.select(*columns).schema).parquet(f"{at}/{n}")
        mine.drop()
        passing(spark, at)
        return spark.read.schema(below.schema).option("recursiveFileLookup", "true").parquet(at)
