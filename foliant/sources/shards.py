"""Scan shards: text files of ``name, dir_path, size, mtime, kind, category``, tab-separated and escaped."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import escape_tsv, unescape_tsv

FIELDS = ("name", "dir_path", "size", "mtime", "kind", "category")


def read_shards(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Rows of all shards. Blank lines are skipped; a row that isn't six sound fields fails the read, as does a missing shard."""
    lines = spark.read.option("lineSep", "\n").text(paths).where(F.length("value") > 0)
    parts = F.split("value", "\t", -1)
    row = lines.select(F.when(F.size(parts) == len(FIELDS), parts).otherwise(F.raise_error(F.concat(F.lit("malformed shard row: "), F.col("value")))).alias("f"))

    def number(k: int, kind: str):
        n = F.expr(f"try_cast(f[{k}] AS {kind})")
        sound = n.isNotNull() & F.col("f")[k].rlike("^-?[0-9]+$" if k == 3 else "^[0-9]+$")
        return F.when(sound, n).otherwise(F.raise_error(F.concat(F.lit(f"malformed {FIELDS[k]}: "), F.col("f")[k]))).alias(FIELDS[k])

    return row.select(unescape_tsv(F.col("f")[0]).alias("name"), unescape_tsv(F.col("f")[1]).alias("dir_path"), number(2, "bigint"), number(3, "bigint"), number(4, "int"), number(5, "int"))


def shard_lines(entries: DataFrame) -> DataFrame:
    return entries.select(F.concat_ws("\t", escape_tsv(F.col("name")), escape_tsv(F.col("dir_path")), *(F.col(c).cast("string") for c in FIELDS[2:])).alias("value"))


def write_shards(entries: DataFrame, path: str) -> None:
    shard_lines(entries).write.mode("overwrite").option("lineSep", "\n").text(path)
