"""Token-id files: Simple-8b word-aligned coding with escapes and per-block offsets.

A segment codes a run of ids. Its ids are cut into blocks of BLOCK; a block is a
run of 64-bit words, and ``offsets`` has the first word of each block, so blocks
can be packed and unpacked side by side. A word's top four bits select how many
ids share the other sixty:

    selector  1  2  3  4  5  6  7  8  9 10 11 12 13 14
    ids      60 30 20 15 12 10  8  7  6  5  4  3  2  1
    bits      1  2  3  4  5  6  7  8 10 12 15 20 30 60

Selector 15 is an escape: it has the low sixty bits of an id beyond 2^60, and the
next word, of selector 14, the high ones. A block's last word may have room left.

A file set is a folder of Parquet files, written by Spark's committer (a retried
task leaves no double), one row per segment:
part and segment (their order), inside (ids of the part before it), n_ids, doc_ids
(an array, of whatever type the ids have), lengths (uint32: ids of each document),
offsets (uint32) and words (uint64), the last three as little-endian bytes. Rows in
order of (part, segment) hold documents in ascending order of id.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .session import bounded_batches, fresh_path, passing
from .textbatch import Pool, WordTable, arrow_batches, bpe_units, spread, sums, text_bytes

BLOCK = 128
# Fixed by the coding.
COUNTS = np.array([0, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1, 1])
BITS = np.array([0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60, 60])
ESCAPE = 15
END_ID = 2

def bit_length(x: np.ndarray) -> np.ndarray:
    """How many bits each unsigned number has; floats are exact for either half."""
    high = x >> np.uint64(32)
    low = np.frexp((x & np.uint64(0xFFFFFFFF)).astype(np.float64))[1]
    return np.where(high > 0, 32 + np.frexp(high.astype(np.float64))[1], low) if high.any() else low


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words and block offsets of unsigned ids."""
    ids = np.asarray(ids, np.uint64)
    n = len(ids)
    blocks = -(-n // BLOCK)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(1, np.uint32)
    room = np.zeros((blocks, BLOCK), np.uint64)
    room.reshape(-1)[:n] = ids
    # the most bits of any id in the 1, 2, 4, ... places from each on; nothing stands behind a block
    most = {1: np.zeros((blocks, BLOCK + 64), np.uint8)}
    most[1][:, :BLOCK] = bit_length(room)
    for k in (1, 2, 4, 8, 16):
        most[2 * k] = np.maximum(most[k][:, :-k], most[k][:, k:])
    choice = np.full((blocks, BLOCK), ESCAPE, np.uint8)
    for s in range(14, 0, -1):  # the last that fits packs the most
        n_ids, half = int(COUNTS[s]), 1 << (int(COUNTS[s]).bit_length() - 1)
        bits = np.maximum(most[half][:, :BLOCK], most[half][:, n_ids - half : n_ids - half + BLOCK])
        np.copyto(choice, np.uint8(s), where=bits <= BITS[s])
    length = np.full(blocks, BLOCK)
    length[-1] = n - BLOCK * (blocks - 1)
    at, live, seen = np.zeros(blocks, np.int64), np.arange(blocks), []
    while len(live):
        s = choice[live, at[live]]
        seen.append((live, at[live], s))
        at[live] += COUNTS[s]
        live = live[at[live] < length[live]]
    block, pos, sel = (np.concatenate(x) for x in zip(*seen, strict=True))
    order = np.lexsort((pos, block))
    block, pos, sel = block[order], pos[order], sel[order]
    size = 1 + (sel == ESCAPE)
    to = np.cumsum(size) - size
    words = np.zeros(int(size.sum()), np.uint64)
    padded = np.zeros((blocks, BLOCK + 60), np.uint64)
    padded[:, :BLOCK] = room
    flat = padded.reshape(-1)
    begin = block * (BLOCK + 60) + pos
    for s in range(1, ESCAPE):
        which = np.flatnonzero(sel == s)
        if len(which):
            word = np.full(len(which), s << 60, np.uint64)
            for j in range(COUNTS[s]):
                word |= flat[begin[which] + j] << np.uint64(j * BITS[s])
            words[to[which]] = word
    which = np.flatnonzero(sel == ESCAPE)
    if len(which):
        value = flat[begin[which]]
        words[to[which]] = np.uint64(ESCAPE << 60) | (value & np.uint64((1 << 60) - 1))
        words[to[which] + 1] = np.uint64(14 << 60) | (value >> np.uint64(60))
    offsets = np.zeros(blocks + 1, np.uint32)
    offsets[1:] = np.cumsum(np.bincount(block, size, blocks))
    return words, offsets


def unpack(words: np.ndarray, offsets: np.ndarray, n: int) -> np.ndarray:
    """The n ids of a segment."""
    out = np.zeros(n, np.uint64)
    if not n:
        return out
    sel = (words >> np.uint64(60)).astype(np.int64)
    count = COUNTS[sel]
    high = np.flatnonzero(sel == ESCAPE) + 1
    count[high] = 0
    sel[high] = 0
    total = np.concatenate([[0], np.cumsum(count)])
    block = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets.astype(np.int64)))
    pos = total[:-1] - total[offsets.astype(np.int64)[block]] + block * BLOCK
    end = np.minimum(n, (block + 1) * BLOCK)
    for s in range(1, 16):
        which = np.flatnonzero(sel == s)
        if not len(which):
            continue
        mask, room, first, w = np.uint64((1 << int(BITS[s])) - 1), end[which] - pos[which], pos[which], words[which]
        for j in range(COUNTS[s]):
            keep = slice(None) if j == 0 else room > j
            out[first[keep] + j] = (w[keep] >> np.uint64(j * BITS[s])) & mask
    if len(high):
        out[pos[high - 1]] |= (words[high] & np.uint64(15)) << np.uint64(60)
    return out


class LibraryEncoder:
    """Ids of whole texts as the tokenizers library gives them.

    Regular texts are split into units (see bpe_units); each distinct unit goes
    through the library once while it stays in a bounded table. Other texts, and those
    that hold a string which the tokenizer adds as a token, go through it whole. Units go end to end, many to a call: no token crosses a unit's
    start, so the bytes of the tokens tell which are whose.
    """

    JOINED = 256

    def __init__(self, path: str, capacity: int = 1 << 20) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.pool = Pool(np.uint32)
        self.table = WordTable(self._fill, capacity)
        vocabulary = self.tokenizer.get_vocab()
        self.size = np.zeros(max(vocabulary.values()) + 1, np.int64)  # a token's letters stand for a byte each
        for token, k in vocabulary.items():
            self.size[k] = len(token)

    def library(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _fill(self, units: list[bytes]) -> None:
        # a text's first unit has no separator in front and so begins a text here as well
        cuts = [k for k, u in enumerate(units) if not k % self.JOINED or u[:1] not in (b" ", b"\n")]
        rows = self.library([b"".join(units[i:j]).decode() for i, j in zip(cuts, [*cuts[1:], len(units)], strict=True)])
        ids = np.concatenate([np.array(r, np.uint32) for r in rows])
        ends = np.cumsum(self.size[ids])
        wanted = np.cumsum(np.fromiter(map(len, units), np.int64, len(units)))
        last = np.searchsorted(ends, wanted)
        if last[-1] == len(ids) - 1 and (ends[last] == wanted).all():
            self.pool.extend_flat(ids, np.diff(last, prepend=-1))
        else:  # a vocabulary of another kind
            self.pool.extend(self.library([u.decode() for u in units]))

    def __call__(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids end to end, and how many each text has."""
        if self.table.reset_if_full():
            self.pool.clear()
        buf, offsets = text_bytes(col)
        starts, ends, units, regular = bpe_units(buf, offsets)
        if added := [np.asarray(pc.fill_null(pc.match_substring(col, a), False)) for a in self.added]:
            holds = np.logical_or.reduce(added)
            if holds.any():
                starts, ends = (x[np.repeat(~holds, units)] for x in (starts, ends))
                units, regular = np.where(holds, 0, units), regular & ~holds
        ids, count = self.pool.gather(self.table.ids(buf, starts, ends))
        per = sums(count, units)
        odd = np.flatnonzero(~regular)
        if len(odd):
            rest = self.library([buf[offsets[k] : offsets[k + 1]].tobytes().decode() for k in odd.tolist()])
            per[odd] = [len(x) for x in rest]
            merged = np.zeros(int(per.sum()), np.uint32)
            first = np.cumsum(per) - per
            merged[spread(first[regular], per[regular])] = ids
            merged[spread(first[odd], per[odd])] = np.fromiter((i for x in rest for i in x), np.uint32)
            ids = merged
        return ids, per


_encoders: dict[str, LibraryEncoder] = {}


def encoder(path: str) -> LibraryEncoder:
    """One per worker process, so its table outlives a task."""
    if path not in _encoders:
        _encoders[path] = LibraryEncoder(path)
    return _encoders[path]


def write(docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, partitions: int | None = None) -> None:
    """Encode every text and write the file set, in ascending id order.

    Nulls: a null text is empty and yields the end id alone; a null id sorts
    first. Repeated ids keep all their rows, side by side, by a hash of their text and
    then as they were read; so one id, or one row, that a third of the table repeats
    is spread over ranges like any others. The one shuffle moves the texts into
    ranges of (id, hash, row); each task sorts its range and codes it batch by batch.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    id_type = docs.schema[id_col].dataType
    keys = [F.col("doc_id").asc_nulls_first(), "hash", "row"]
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("hash"), F.monotonically_increasing_id().alias("row"))
    parted = docs.repartitionByRange(n, *keys).sortWithinPartitions(*keys).select("doc_id", "text", F.spark_partition_id().alias("part"))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, inside = encoder(tokenizer), 0
        for k, batch in enumerate(arrow_batches(batches)):
            ids, count = encode(batch.column("text"))
            length = count + 1
            whole = np.full(int(length.sum()), end_id, np.uint64)
            whole[spread(np.cumsum(length) - length, count)] = ids
            words, offsets = pack(whole)
            doc_ids = batch.column("doc_id")
            numbers = {"part": batch.column("part").slice(0, 1), "segment": pa.array([k], pa.int32()), "inside": pa.array([inside], pa.int64()), "n_ids": pa.array([len(whole)], pa.int64())}
            coded = {name: pa.array([x.tobytes()], pa.binary()) for name, x in (("lengths", length.astype(np.uint32)), ("offsets", offsets), ("words", words))}
            yield pa.RecordBatch.from_pydict({**numbers, "doc_ids": pa.ListArray.from_arrays(pa.array([0, len(doc_ids)], pa.int32()), doc_ids), **coded})
            inside += len(whole)

    parted.mapInArrow(code, segment_schema(id_type)).write.mode("overwrite").option("compression", "zstd").parquet(path)


def segment_schema(id_type: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in (("part", T.IntegerType()), ("segment", T.IntegerType()), ("inside", T.LongType()), ("n_ids", T.LongType()), ("doc_ids", T.ArrayType(id_type)), ("lengths", T.BinaryType()), ("offsets", T.BinaryType()), ("words", T.BinaryType()))])


def segments(spark: SparkSession, path: str) -> DataFrame:
    """The file set's segments with ``start``: how many ids all earlier ones have.

    A segment knows how many its part has before it. The parts' totals, one row for
    each range of ids that was written, are summed up and joined back; the coded words
    stay where they are.
    """
    rows = spark.read.parquet(path)
    base, sofar = [], 0
    for row in sorted(rows.groupBy("part").agg(F.sum("n_ids").alias("all_ids")).collect()):
        base.append((row.part, sofar))
        sofar += row.all_ids
    starts = spark.createDataFrame(base, "part int, base long")
    return rows.join(F.broadcast(starts), "part").withColumn("start", F.col("base") + F.col("inside"))


def read(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """Decode a file set: doc_id, start, n_tokens, ids_crc32 and, if asked for, ids."""
    bounded_batches(spark)
    rows = segments(spark, path)
    schema = T.StructType([T.StructField("doc_id", rows.schema["doc_ids"].dataType.elementType), *(T.StructField(n, T.LongType()) for n in ("start", "n_tokens", "ids_crc32"))])
    if with_ids:
        schema = schema.add("ids", T.ArrayType(T.LongType()))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow_batches(batches, 1):  # a row is a whole segment here
            start, n_ids, lengths, offsets, words = (batch.column(c)[0].as_py() for c in ("start", "n_ids", "lengths", "offsets", "words"))
            length = np.frombuffer(lengths, np.uint32).astype(np.int64)
            ids = unpack(np.frombuffer(words, np.uint64), np.frombuffer(offsets, np.uint32), n_ids)
            end = np.cumsum(length)
            raw = memoryview(ids.astype("<u4").tobytes())
            out = {
                "doc_id": batch.column("doc_ids")[0].values,
                "start": pa.array(start + end - length),
                "n_tokens": pa.array(length),
                "ids_crc32": pa.array([zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(end.tolist(), length.tolist(), strict=True)], pa.int64()),
            }
            if with_ids:
                out["ids"] = pa.ListArray.from_arrays(np.concatenate([[0], end]).astype(np.int32), pa.array(ids.astype(np.int64)))
            yield pa.RecordBatch.from_pydict(out)

    return rows.select("start", "n_ids", "doc_ids", "lengths", "offsets", "words").mapInArrow(decode, schema)


def encode_files(docs: DataFrame, tokenizer: str, path: str | None = None, with_ids: bool = False, **named: object) -> DataFrame:
    """Write ``docs`` as a file set at ``path`` and read it back; without one in the shared folder, until the driver ends."""
    spark = docs.sparkSession
    at = path or fresh_path(spark, "token-ids")
    write(docs, at, tokenizer, **named)
    return read(spark, at if path else passing(spark, at), with_ids)
