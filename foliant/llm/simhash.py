"""SimHash near-duplicates, linked with the help of pivot distance tables.

A fingerprint's bit is 1 if it is set in over half of the hashes of a text's word
shingles. Two texts link if their fingerprints differ in at most ``RADIUS`` bits.

Links between distinct fingerprints are found so:

1. Pigeonhole: the bits are parted into BLOCKS blocks. Fingerprints within RADIUS
   bits of each other are equal in at least BLOCKS - RADIUS of them, so they meet
   in one of the buckets of the tables, one table for each choice of that many blocks.
2. Pivot table: for each distinct fingerprint the Hamming distances to PIVOTS fixed
   reference fingerprints are computed once. By the triangle inequality a pair
   within RADIUS differs by at most RADIUS in every coordinate; pairs of a bucket
   with a larger maximum coordinate difference are discarded.
3. Survivors are verified by the distance itself.

A bucket gives no list of its pairs but, for each member, the smallest member of
its component inside the bucket: never more rows than it has members. A bucket of
over BUCKET members is cut into chunks, and each pair of chunks is a bucket of its
own, so no task holds more than two chunks and no pair is lost.

Texts with fewer words than a shingle are one shingle; a text without words (or
null) has fingerprint zero and links like any other. Equal fingerprints are one
node, so exact copies meet in a partial aggregate. Null ids never name a component
that has another id.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .graph import stars
from .session import bounded_batches, free_name, room_for, written
from .textbatch import arrow_batches, mix

WORDS = 3
RADIUS = 3
SEED = 42
BLOCKS = 5
PIVOTS = 16
BUCKET = 2048


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """Unsigned 64-bit fingerprint of one text."""
    from xxhash import xxh64_intdigest

    w = (text or "").encode().lower().split()  # bytes.lower folds A-Z alone, bytes.split parts at \x20\x09-\x0D
    if not w:
        return 0
    if len(w) <= words:
        return xxh64_intdigest(b" ".join(w), SEED)
    joined = b" ".join(w)
    size = np.fromiter(map(len, w), np.int64, len(w)) + 1
    end = np.cumsum(size) - 1
    begin = (end - size + 1)[: len(w) - words + 1].tolist()
    end = end[words - 1 :].tolist()
    n, ones = len(begin), np.zeros(64, np.int64)
    for k in range(0, n, 1 << 15):
        h = np.fromiter((xxh64_intdigest(joined[i:j], SEED) for i, j in zip(begin[k : k + (1 << 15)], end[k : k + (1 << 15)], strict=True)), np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def with_fingerprint(docs: DataFrame, text_col: str = "text", words: int = WORDS, name: str | None = None) -> DataFrame:
    """``docs`` with one more column, the last: the fingerprint as a signed long. By default its name is a free one like ``fp``. No shuffle."""
    bounded_batches(docs.sparkSession)
    docs, name = room_for(docs, name, "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow_batches(batches):
            got = np.array([fingerprint(t, words) for t in batch.column(text_col).to_pylist()], np.uint64)
            yield batch.append_column(name, pa.array(got.view(np.int64)))

    return docs.mapInArrow(run, T.StructType([*docs.schema, T.StructField(name, T.LongType())]))


def pivots() -> list[int]:
    """Reference fingerprints: fixed, spread over the space by a 64-bit mixer."""
    return [int(x) for x in mix(np.arange(1, PIVOTS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)]


def _block_masks() -> list[int]:
    edges = [64 * k // BLOCKS for k in range(BLOCKS + 1)]
    return [((1 << (b - a)) - 1) << a for a, b in zip(edges[:-1], edges[1:], strict=True)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def bucket_rows(nodes: DataFrame) -> DataFrame:
    """Each fingerprint with its pivot distances, once for each table: (bucket, chunk, fp, far)."""
    # eight distances of seven bits to a long
    far = F.array(*(sum((F.shiftleft(F.bit_count(F.col("fp").bitwiseXOR(F.lit(p))).cast("long"), 7 * k) for k, p in enumerate(pivots()[at : at + 8])), F.lit(0).cast("long")) for at in range(0, PIVOTS, 8)))
    masks = _block_masks()
    tables = [sum(masks[k] for k in chosen) for chosen in combinations(range(BLOCKS), BLOCKS - RADIUS)]
    keys = F.array(*(F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("bits")) for t, m in enumerate(tables)))
    rows = nodes.select("fp", far.alias("far"), F.explode(keys).alias("bucket")).select("bucket.t", "bucket.bits", "fp", "far")
    hot = rows.groupBy("t", "bits").count().where(F.col("count") > BUCKET).withColumn("chunks", F.ceil(F.col("count") / BUCKET).cast("int")).drop("count")
    rows = rows.join(hot, ["t", "bits"], "left")
    own = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
    # the pairs of chunks that this one is part of; outside hot buckets there is one
    pairs = F.when(F.col("chunks").isNull(), F.array(F.lit(-1))).otherwise(F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda k: F.least(k, own) * F.col("chunks") + F.greatest(k, own)))
    return rows.select("t", "bits", F.explode(pairs).alias("chunk"), "fp", "far")


def _links(fp: np.ndarray, far: np.ndarray) -> np.ndarray:
    """The smallest member of each member's component; members of one bucket."""
    order = np.argsort(far[:, 0], kind="stable")
    fp, far = fp[order], far[order].astype(np.int16)
    parent = list(range(len(fp)))

    def root(k: int) -> int:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    for a in range(0, len(fp), 256):
        b = min(a + 256, len(fp))
        last = int(np.searchsorted(far[:, 0], far[b - 1, 0] + RADIUS, side="right"))
        i, j = np.nonzero(far[a:last, 0][None, :] - far[a:b, 0][:, None] <= RADIUS)
        keep = j > i
        i, j = i[keep] + a, j[keep] + a
        for p in range(1, far.shape[1]):  # pair by pair, coordinate by coordinate, those still within
            keep = np.abs(far[i, p] - far[j, p]) <= RADIUS
            i, j = i[keep], j[keep]
        keep = np.bitwise_count((fp[i] ^ fp[j]).view(np.uint64)) <= RADIUS
        for x, y in zip(i[keep].tolist(), j[keep].tolist(), strict=True):
            x, y = root(x), root(y)
            if x != y:
                parent[max(x, y, key=fp.__getitem__)] = min(x, y, key=fp.__getitem__)
    out = np.empty(len(fp), np.int64)
    out[order] = fp[[root(k) for k in range(len(fp))]]
    return out


def _bucket_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by bucket; a bucket that a batch cuts is held back for the next."""
    held: list[pa.RecordBatch] = []

    def done(table: pa.Table) -> Iterator[pa.RecordBatch]:
        if not table.num_rows:
            return
        fp = table.column("fp").to_numpy()
        packed = table.column("far").combine_chunks().flatten().to_numpy().reshape(len(fp), -1)
        cut = _cuts(table)
        size = np.diff(cut)
        u, v = [], []
        if (two := cut[:-1][size == 2]).size:  # most buckets: all of them at once
            far = unpack_far(packed[two]), unpack_far(packed[two + 1])
            keep = np.abs(far[0] - far[1]).max(axis=1) <= RADIUS
            two = two[keep]
            two = two[np.bitwise_count((fp[two] ^ fp[two + 1]).view(np.uint64)) <= RADIUS]
            u, v = [np.maximum(fp[two], fp[two + 1])], [np.minimum(fp[two], fp[two + 1])]
        for k in np.flatnonzero(size > 2).tolist():
            part = slice(cut[k], cut[k + 1])
            least = _links(fp[part], unpack_far(packed[part]))
            linked = least != fp[part]
            u.append(fp[part][linked])
            v.append(least[linked])
        if u:
            yield pa.RecordBatch.from_pydict({"u": pa.array(np.concatenate(u), pa.int64()), "v": pa.array(np.concatenate(v), pa.int64())})

    for batch in arrow_batches(batches, 1 << 20):  # rows are a few numbers here
        table = pa.Table.from_batches([*held, batch])
        last = int(_cuts(table)[-2])
        yield from done(table.slice(0, last))
        held = table.slice(last).combine_chunks().to_batches()
    if held:
        yield from done(pa.Table.from_batches(held))


def _cuts(table: pa.Table) -> np.ndarray:
    """Where a new bucket begins, and the end."""
    differ = np.zeros(table.num_rows, bool)
    differ[0] = True
    for name in ("t", "bits", "chunk"):
        x = table.column(name).to_numpy()
        differ[1:] |= x[1:] != x[:-1]
    return np.append(np.flatnonzero(differ), table.num_rows)


def unpack_far(packed: np.ndarray) -> np.ndarray:
    return np.concatenate([(packed >> (7 * k)) & 127 for k in range(8)], axis=1)


def components(nodes: DataFrame) -> DataFrame:
    """nodes: distinct fingerprints ``fp``. Returns (fp, root): root is the same for all that are linked, directly or through others."""
    spark = nodes.sparkSession
    rows = bucket_rows(nodes)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    links = rows.repartition(n, "t", "bits", "chunk").sortWithinPartitions("t", "bits", "chunk").mapInArrow(_bucket_links, "u long, v long")
    found = stars(links)
    return nodes.join(found.select(F.col("u").alias("fp"), F.col("v").alias("root")), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))


def hex_digits(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """A row per document: its fingerprint and the smallest id it is linked to, itself included."""
    prints = written(with_fingerprint(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "text", words, "fp").select("doc_id", "fp"), "simhash-prints")
    nodes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-nodes")
    roots = components(nodes.select("fp"))
    named = nodes.join(roots, "fp")
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    of = written(named.join(ids, "root").select("fp", "component_id"), "simhash-components")
    return prints.join(of, "fp").select("doc_id", hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """One row of each component, that of the smallest id (null ids last; of repeated rows any one). Columns as they are."""
    columns = docs.columns
    docs = with_fingerprint(docs, text_col, words)
    fp, row = docs.columns[-1], free_name(docs, "row")
    # written once with a row number, so what is kept can be named exactly
    held = written(docs.withColumn(row, F.monotonically_increasing_id()), "simhash-documents")
    prints = held.select(F.col(id_col).alias("id"), F.col(fp).alias("fp"), F.col(row).alias("row"))
    first = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "row")).alias("first")
    nodes = written(prints.groupBy("fp").agg(first), "simhash-nodes")
    keep = nodes.join(components(nodes.select("fp")), "fp").groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.row").alias(row))
    return held.join(keep, row, "left_semi").select(*columns)
