"""The folder that the driver and all executors share, and who owns what is written there."""

from __future__ import annotations

import re
import tempfile
import uuid
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """As the session names it in ``spark.checkpoint.dir``.

    One of our own is set only where there is none and all tasks run in the
    driver's process: elsewhere a folder of the driver's is not known to be shared.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        at = spark.sparkContext.getCheckpointDir()
        if not at:
            if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            at = tempfile.mkdtemp(prefix="foliant-")
            spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def fresh_path(spark: SparkSession, stem: str) -> str:
    return f"{shared_dir(spark)}/{stem}-{uuid.uuid4().hex}"


_current: ContextVar[Run | None] = ContextVar("run", default=None)


class Run:
    """Owner of the folders that ``written`` makes while it is entered, in this thread alone.

    ``drop`` deletes them, or all but the newest; so no run deletes what another one
    reads. What is left goes to the run around it, or else stays until the driver ends.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.paths = spark, []

    def __enter__(self) -> Run:
        self._before = _current.set(self)
        return self

    def __exit__(self, *_: object) -> None:
        _current.reset(self._before)
        outer = _current.get()
        if outer:
            outer.paths += self.paths

    def drop(self, but: int = 0) -> None:
        end = len(self.paths) - but
        for path in self.paths[:end]:
            files, at = _folder(self.spark, path)
            files.delete(at, True)
            files.cancelDeleteOnExit(at)
        del self.paths[:end]


def _folder(spark: SparkSession, path: str) -> tuple:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def passing(spark: SparkSession, path: str) -> str:
    """Have a folder that was written deleted when the driver ends, or before by the run that owns it."""
    files, at = _folder(spark, path)
    files.deleteOnExit(at)
    owner = _current.get()
    if owner:
        owner.paths.append(path)
    return path


def written(df: DataFrame, stem: str) -> DataFrame:
    """``df`` as Parquet in the shared folder, read again: a lost executor costs no more than a reread."""
    spark = df.sparkSession
    path = fresh_path(spark, stem)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(passing(spark, path))
