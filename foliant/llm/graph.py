"""Connected components of a link table, by alternating large-star and small-star rounds.

Every round is a grouped minimum and a join, written in the shared folder, where only
the newest round stays; neither links nor labels pass through the driver. Each round keeps the components and
moves links toward each component's smallest member, until all are stars.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import Run, written


def _digest(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def stars(links: DataFrame) -> DataFrame:
    """links (u, v), u != v. Returns (u, v): v is the smallest node of u's component, for all u but that."""
    with Run(links.sparkSession) as mine:
        links = written(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct(), "links")
        was = _digest(links)
        while True:
            links = written(_round(links), "links")
            mine.drop(but=1)
            now = _digest(links)
            if now == was:
                return links
            was = now


def _round(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    least = large.groupBy("u").agg(F.min("v").alias("m"))
    small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u > v")
    return small.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
