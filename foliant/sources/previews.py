"""First bytes of files, read by tasks: no more of a file than its preview shows."""

from __future__ import annotations

import os
import stat
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.names import join_path, preview_format, preview_highlighted, preview_text

#: Bytes that are shown, and bytes up to which a file is highlighted.
SHOWN, HIGHLIGHTED = 20 << 20, 5 << 20
#: Bytes of content in one batch of rows, but one row at least.
BATCH_BYTES = 4 << 20


def first_bytes(path: str, most: int) -> bytes | None:
    """Of a regular file; none of anything else, and of what isn't there or can't be read."""
    try:
        if not stat.S_ISREG(os.stat(path).st_mode):
            return None
        with open(path, "rb", buffering=0) as f:
            parts, left = [], most
            while left and (part := f.read(left)):
                parts.append(part)
                left -= len(part)
            return b"".join(parts)
    except OSError:
        return None


def with_content(rows: DataFrame, path: str, most: int = SHOWN, name: str = "content") -> DataFrame:
    """``rows`` with the first ``most`` + 1 bytes of each one's file, so that it shows whether there are more. The files have to be mounted on the executors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: list[bytes | None] = []
            begin = size = 0
            for k, at in enumerate(batch.column(path).to_pylist()):
                held.append(None if at is None else first_bytes(at, most + 1))
                size += len(held[-1] or b"")
                if size >= BATCH_BYTES or k == batch.num_rows - 1:
                    yield batch.slice(begin, k + 1 - begin).append_column(name, pa.array(held, pa.binary()))
                    held, begin, size = [], k + 1, 0

    rows = rows.drop(name)
    return rows.mapInArrow(run, T.StructType([*rows.schema, T.StructField(name, T.BinaryType())]))


def previews(entries: DataFrame, shown: int = SHOWN, highlighted: int = HIGHLIGHTED) -> DataFrame:
    """(path, format, text, highlighted) of entries that are previewed as text; null text for what is no readable file."""
    known = entries.select(join_path(F.col("dir_path"), F.col("name")).alias("path"), preview_format(F.col("name"), F.col("kind")).alias("format")).where("format is not null")
    read = with_content(known, "path", shown)
    return read.select("path", "format", preview_text(F.col("content"), shown).alias("text"), F.coalesce(preview_highlighted(F.col("content"), shown, highlighted), F.lit(False)).alias("highlighted"))
