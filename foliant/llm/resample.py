"""Importance resampling of documents toward a target's distribution of hashed word n-grams.

Features of a text are all runs of 1 to ORDER consecutive words (A-Z folded), joined by one
space, each hashed to one of BUCKETS by CRC-32. A bucket's gain is the log ratio of its
smoothed shares in target and corpus; a text's weight is the mean gain of its features; with
Gumbel noise drawn from seed and id on top of it, the highest scores are a sample without
replacement in proportion to the exponential of the weights.

Work is done once for each distinct text:

1. rows are grouped by full text, so the copies of one text are one row and their number
   (a text that a third of all rows share is summed up before it is sent);
2. its features are computed once and written, as sorted bucket numbers in differences;
3. bucket counts are sums over those rows times the number of copies; what comes to the
   driver is one number for each bucket;
4. its weight is computed once and joined back to the rows by the text's SHA-256, and only
   then do rows get the noise of their own ids.

Null texts are empty texts: no words, no features, weight 0, never drawn. A null id counts
as an empty string in the noise and comes last among equal scores. Repeated rows are drawn
one by one. Empty tables give empty results; an empty target gives gains of its smoothing.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.search import rank_rows
from .session import bounded_batches, free_name, written
from .textbatch import arrow_batches, fold_ascii, plain_words, sums, text_bytes

BUCKETS, ORDER = 10_000, 2
SCALE = 1000
#: Documents of fewer words are never drawn; of the others so many percent are.
LEAST_WORDS, PERCENT = 20, 25
SEED = 7
#: Words of over so many bytes are left to zlib, one by one.
LONG_WORD = 64


def _crc_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(0xEDB88320), c >> 1)
    return c


_CRC = _crc_table()
_ALL = np.uint32(0xFFFFFFFF)


def crc_spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 of each span of bytes, a byte of all spans at a time."""
    size = ends - starts
    crc = np.full(len(size), _ALL)
    order = np.argsort(-size, kind="stable")
    long = int((size > LONG_WORD).sum())
    order, long_ones = order[long:], order[:long]
    falling = -size[order]
    for k in range(int(-falling[0]) if len(order) else 0):
        at = order[: int(np.searchsorted(falling, -k))]  # those that have a byte k
        c = crc[at]
        crc[at] = (c >> np.uint32(8)) ^ _CRC[(c ^ buf[starts[at] + k]) & np.uint32(255)]
    crc ^= _ALL
    for k in long_ones.tolist():
        crc[k] = zlib.crc32(buf[starts[k] : ends[k]])
    return crc


def _then_zeros() -> Iterator[np.ndarray]:
    """For 1, 2, 4, ... zero bytes behind a text: what its CRC's four bytes add to the new one, as four tables."""
    byte = np.arange(256, dtype=np.uint32)
    tables = np.stack([byte << np.uint32(8 * k) for k in range(4)])
    step = (tables >> np.uint32(8)) ^ _CRC[tables & np.uint32(255)]
    while True:
        yield step
        step = _looked_up(step, step)


def _looked_up(tables: np.ndarray, crc: np.ndarray) -> np.ndarray:
    out = tables[0][crc & np.uint32(255)]
    for k in range(1, 4):
        out = out ^ tables[k][(crc >> np.uint32(8 * k)) & np.uint32(255)]
    return out


def crc_joined(head: np.ndarray, tail: np.ndarray, tail_size: np.ndarray) -> np.ndarray:
    """CRC-32 of texts put end to end, from those of both parts and the second one's bytes."""
    left = tail_size.copy()
    for tables in _then_zeros():
        if not left.any():
            return head ^ tail
        odd = np.flatnonzero(left & 1)
        head[odd] = _looked_up(tables, head[odd])
        left >>= 1


def feature_buckets(texts: pa.Array, order: int = ORDER, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of each feature, end to end and sorted inside a text; words of each text; features of each text)."""
    buf, offsets = text_bytes(texts)
    buf = fold_ascii(buf)
    starts, ends, words = plain_words(buf, offsets)
    text = np.repeat(np.arange(len(words)), words)
    word, size = crc_spans(buf, starts, ends), ends - starts
    run, of, found = word, text, [(text, word)]
    for k in range(1, order):
        keep = of[: max(0, len(of) - 1)] == text[k:] if len(text) > k else np.zeros(0, bool)
        # runs one word longer; behind the head comes a blank
        head = run[: len(keep)] ^ _ALL
        head = ((head >> np.uint32(8)) ^ _CRC[(head ^ np.uint32(32)) & np.uint32(255)]) ^ _ALL
        run = crc_joined(head, word[k:], size[k:])
        of = np.where(keep, text[: len(keep)], -1)
        found.append((of[keep], run[keep]))
    of, crc = (np.concatenate(x) for x in zip(*found, strict=True))
    key = (of.astype(np.int64) << 32) | (crc % np.uint32(buckets))
    key.sort()
    return key & 0xFFFFFFFF, words, np.bincount(of, minlength=len(words))


def _packed(sorted_buckets: np.ndarray, count: np.ndarray) -> pa.Array:
    """Sorted numbers of each text as differences."""
    end = np.cumsum(count)
    step = np.diff(sorted_buckets, prepend=0)
    first = (end - count)[count > 0]
    step[first] = sorted_buckets[first]
    at = np.concatenate([[0], 4 * end]).astype(np.int64)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(count), [None, pa.py_buffer(at.tobytes()), pa.py_buffer(step.astype("<u4").tobytes())])


def _unpacked(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """As feature_buckets has them: numbers end to end, and how many each text has."""
    col = col.cast(pa.large_binary())
    if not len(col):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    step = np.frombuffer(col.buffers()[2], np.uint8)[at[0] : at[-1]].view("<u4").astype(np.int64) if at[-1] > at[0] else np.zeros(0, np.int64)
    count = np.diff(at) // 4
    total = np.cumsum(step)
    begin = (np.cumsum(count) - count)[count > 0]
    before = np.zeros(len(step), np.int64)
    if len(begin):
        before = np.repeat(np.where(begin > 0, total[begin - 1], 0), count[count > 0])
    return total - before, count


FEATURES = "digest binary, copies long, n_words long, n_features long, buckets binary"


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def distinct_features(docs: DataFrame, text_col: str = "text", order: int = ORDER, buckets: int = BUCKETS) -> DataFrame:
    """A row of FEATURES for each distinct text, written in the shared folder."""
    bounded_batches(docs.sparkSession)
    texts = docs.groupBy(F.coalesce(F.col(text_col), F.lit("")).alias("text")).agg(F.count(F.lit(1)).alias("copies"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in arrow_batches(batches):
            found, words, count = feature_buckets(b.column("text"), order, buckets)
            yield pa.RecordBatch.from_pydict({"digest": b.column("digest"), "copies": b.column("copies"), "n_words": words, "n_features": count, "buckets": _packed(found, count).cast(pa.binary())})

    return written(texts.withColumn("digest", digest(F.col("text"))).mapInArrow(run, FEATURES), "resample-features")


def bucket_counts(features: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features in each bucket over all rows: a number for each bucket from each task, summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in arrow_batches(batches):
            found, count = _unpacked(b.column("buckets"))
            copies = np.repeat(b.column("copies").to_numpy(), count)
            for n in np.unique(copies).tolist():
                total += n * np.bincount(found[copies == n], minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"bucket": some, "n": total[some]})

    out = np.zeros(buckets, np.int64)
    for r in features.select("copies", "buckets").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains(target: np.ndarray, corpus: np.ndarray) -> np.ndarray:
    """Log ratio of the smoothed shares of each bucket, in thousandths, rounded down."""
    one = float(int(corpus.sum()) + len(corpus))
    other = float(int(target.sum()) + len(target))
    return np.array([math.floor(SCALE * math.log((t + 1.0) * one / ((s + 1.0) * other))) for t, s in zip(target.tolist(), corpus.tolist(), strict=True)], np.int64)


def text_weights(features: DataFrame, gain: np.ndarray) -> DataFrame:
    """(digest, n_words, n_features, weight) of each distinct text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in arrow_batches(batches):
            found, count = _unpacked(b.column("buckets"))
            total = sums(gain[found], count)
            yield pa.RecordBatch.from_pydict({"digest": b.column("digest"), "n_words": b.column("n_words"), "n_features": b.column("n_features"), "weight": np.where(count > 0, total // np.maximum(count, 1), 0)})

    return features.select("digest", "n_words", "n_features", "buckets").mapInArrow(run, "digest binary, n_words long, n_features long, weight long")


def noise(row_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths, rounded down, fixed by seed and id."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(row_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-float(SCALE)) * F.log(-F.log((h + 0.5) / 4294967296.0)))


@dataclass(frozen=True)
class Draw:
    """How much is drawn, of what, with which noise."""

    least_words: int = LEAST_WORDS
    percent: int = PERCENT
    seed: int = SEED


def scored(docs: DataFrame, target: DataFrame, text_col: str = "text", target_col: str = "text", id_col: str = "doc_id", draw: Draw = Draw(), order: int = ORDER, buckets: int = BUCKETS) -> DataFrame:
    """``docs`` with a struct column: n_words, n_features, weight, score. Its name is the last one's."""
    features = distinct_features(docs, text_col, order, buckets)
    gain = gains(bucket_counts(distinct_features(target, target_col, order, buckets), buckets), bucket_counts(features, buckets))
    key, name = free_name(docs, "digest"), free_name(docs, "importance")
    weights = text_weights(features, gain).select(F.col("digest").alias(key), F.struct("n_words", "n_features", "weight").alias(name))
    joined = docs.withColumn(key, digest(F.col(text_col))).join(weights, key).drop(key)
    return joined.withColumn(name, F.col(name).withField("score", F.col(f"{name}.weight") + noise(F.col(id_col), draw.seed)))


def report(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", draw: Draw = Draw(), order: int = ORDER, buckets: int = BUCKETS) -> DataFrame:
    """A row per document: n_features, weight, score, and its rank among those drawn (null: not drawn)."""
    rows = scored(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), target, "text", target_col, "doc_id", draw, order, buckets)
    # the ranking samples its input before it deals it out, and needs the same rows each time
    rows = written(rows.select("doc_id", F.col(f"{rows.columns[-1]}.*")), "resample-scores")
    enough = rows.where(F.col("n_words") >= draw.least_words)
    most = draw.percent * enough.count() // 100
    # equal rows, of which a third of all may be, are told apart by where they lie
    keys = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("row")]
    ranked = rank_rows(enough.withColumn("row", F.monotonically_increasing_id()), keys, "rank").withColumn("rank", F.when(F.col("rank") <= most, F.col("rank")).cast("long"))
    columns = ["doc_id", "n_features", "weight", "score", "rank"]
    rest = rows.where(F.col("n_words") < draw.least_words).withColumn("rank", F.lit(None).cast(T.LongType()))
    return ranked.select(*columns).unionByName(rest.select(*columns))


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", draw: Draw = Draw()) -> DataFrame:
    """The rows drawn, with their columns as they are."""
    columns = docs.columns
    row = free_name(docs, "row")
    held = written(docs.withColumn(row, F.monotonically_increasing_id()), "resample-documents")
    rows = scored(held, target, text_col, target_col, id_col, draw)
    name = rows.columns[-1]
    rows = written(rows.select(F.col(id_col).alias("doc_id"), F.col(row).alias("row"), F.col(f"{name}.n_words").alias("n_words"), F.col(f"{name}.score").alias("score")).where(F.col("n_words") >= draw.least_words), "resample-scores")
    most = draw.percent * rows.count() // 100
    drawn = rank_rows(rows, [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("row")], "rank").where(F.col("rank") <= most)
    return held.join(drawn.select(F.col("row").alias(row)), row, "left_semi").select(*columns)
