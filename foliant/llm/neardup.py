"""Near-duplicate vectors: all pairs with a cosine of LINK or more, counted and joined to components.

The method is a robust-pruned flat graph, built and searched in shards:

1. Rows with equal vectors are one node with a weight.
2. Dense groups: of buckets of random signs that hold very many nodes, sampled means become
   leaders, at most LEADERS. A node within half the linking angle of a leader joins its ball;
   two nodes of one ball always link, so a ball is counted without looking at pairs, however
   many rows it holds. Against the other balls angles decide: all of a ball, none, or (on the
   rim) its members one by one, in blocks of bounded size.
3. All other nodes go to the OVERLAP nearest of clustered centres, so shards overlap. A shard
   of over 1.5 SHARD nodes is cut in chunks, and each pair of chunks is a shard.
4. In each shard a flat graph is built with the robust-prune rule; the lists that a node got
   in its shards are united.
5. In each shard every node searches the united graph: greedily from the shard's medoids and
   its own list, then expanding whatever is in range until nothing new is.
6. Every pair found is verified in double precision, and counted in the smallest of the
   shards that both nodes share, so no pair is counted twice and none is ever emitted: a
   shard gives a count and a representative for each node.
7. An audit compares the counts of AUDIT nodes, chosen by a hash, with brute force over all.
   Under RECALL the graph is built again with twice the overlap, up to ROUNDS times.

Vectors that are null, empty or zero, or that hold a null or a component that is not finite,
link with nothing and are components of their own. Vectors of different lengths don't link;
more than LENGTHS lengths are an error. Repeated ids are rows of their own. Null ids never
name a component that has another id, and are never kept. An empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
import math
import warnings
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .graph import stars
from .session import bounded_batches, free_name, written
from .textbatch import arrow_batches, mix
from .vectorgraph import BATCH, ShardGraph

LINK = 0.9
#: Nodes of a shard, shards of a node, most centres, sampled nodes for each centre.
SHARD, OVERLAP, CENTRES, PER_CENTRE = 4096, 3, 2048, 32
#: Bits of a bucket, nodes of a dense bucket at least, most leaders, sampled nodes of a dense bucket.
SIGNS, DENSE, LEADERS, PER_BUCKET = 16, 48, 1024, 32
AUDIT, RECALL, ROUNDS = 512, 0.95, 3
LENGTHS = 64
#: Angles within this of a bound are not decided by angles.
MARGIN = 1e-6
NODE = "node long, n long, vec binary, mark long"


# Vectors in batches


def _values(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All components end to end (nulls are NaN), each row's length, and which rows are usable."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    size = pc.fill_null(pc.list_value_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = col.flatten()
    flat = np.asarray(flat.cast(flat.type if pa.types.is_floating(flat.type) else pa.float64()).to_numpy(zero_copy_only=False))
    flat = flat + flat.dtype.type(0)  # no negative zero
    usable, full = size > 0, np.flatnonzero(size > 0)
    if len(full):
        at = (np.cumsum(size) - size)[full]
        usable[full] = np.logical_and.reduceat(np.isfinite(flat), at) & np.logical_or.reduceat(flat != 0, at)
    return flat, size, usable


def units(vec: pa.Array | pa.ChunkedArray, kind: str) -> np.ndarray:
    """Unit vectors in double precision, of equally long vectors given as bytes."""
    raw = b"".join(vec.to_pylist())
    x = np.frombuffer(raw, kind).reshape(len(vec), -1).astype(np.float64) if len(vec) else np.zeros((0, 1))
    if len(x):
        x /= np.abs(x).max(axis=1)[:, None]
        x /= np.linalg.norm(x, axis=1)[:, None]
    return x


def rows_of(vectors: DataFrame, id_col: str, vec_col: str) -> tuple[DataFrame, str]:
    """(vec_id, digest, vec) of each row, both null if the vector isn't usable; and numpy's name of the components."""
    kind = "<f4" if isinstance(vectors.schema[vec_col].dataType.elementType, T.FloatType) else "<f8"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in arrow_batches(batches, 4096):
            flat, size, usable = _values(b.column("vec"))
            data, width = flat.astype(kind).tobytes(), np.dtype(kind).itemsize
            end = np.cumsum(size) * width
            vec = [data[j - n * width : j] if ok else None for j, n, ok in zip(end.tolist(), size.tolist(), usable.tolist(), strict=True)]
            digest = [None if v is None else hashlib.sha256(v).digest() for v in vec]
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(digest, pa.binary()), pa.array(vec, pa.binary())], ["vec_id", "digest", "vec"])

    bounded_batches(vectors.sparkSession)
    given = vectors.select(F.col(id_col).alias("vec_id"), F.col(vec_col).alias("vec"))
    return given.mapInArrow(run, T.StructType([given.schema["vec_id"], T.StructField("digest", T.BinaryType()), T.StructField("vec", T.BinaryType())])), kind


def _share(marks: np.ndarray) -> np.ndarray:
    """A number from 0 to 1 for each node's mark."""
    return mix(marks.view(np.uint64)) / 2.0**64


# Dense groups


@dataclass
class Balls:
    """Leaders of dense groups, and of each ball its weight, its number of nodes and its widest angle."""

    leaders: np.ndarray
    first: int
    weight: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    nodes: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    radius: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def own(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ball that each vector joins (-1: none), and its cosine with all leaders."""
        if not len(self.leaders):
            return np.full(len(x), -1), np.zeros((len(x), 0))
        cosine = np.clip(x @ self.leaders.T, -1, 1)
        near = np.argmax(cosine, axis=1)
        # half the angle of LINK, and slightly less
        return np.where(cosine[np.arange(len(x)), near] >= math.sqrt((1 + LINK) / 2) + 1e-4, near, -1), cosine

    def relations(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Own ball, other balls that a vector links with as a whole, and those of which it may link with some."""
        own, cosine = self.own(x)
        angle, most = np.arccos(cosine), math.acos(LINK)
        held = self.nodes > 0
        other = held[None, :] & (np.arange(len(self.leaders))[None, :] != own[:, None])
        whole = other & (angle + self.radius[None, :] <= most - MARGIN)
        return own, whole, other & ~whole & (angle - self.radius[None, :] <= most + MARGIN)


def _leaders(hot: dict[int, int], sample: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    """Means of tight buckets, the fullest first, none within a few degrees of another."""
    join, apart, out = math.sqrt((1 + LINK) / 2), math.cos(math.radians(4)), []
    for b in sorted(hot, key=lambda k: (-hot[k], k)):
        mine = sample[bucket == b]
        for _ in range(2):  # once more, with what is near of all buckets
            centre = mine.mean(axis=0) if len(mine) else np.zeros(sample.shape[1])
            size = np.linalg.norm(centre)
            if size < 1e-9:
                break
            centre /= size
            mine = sample[sample @ centre >= join]
        if size >= 1e-9 and len(mine) >= PER_BUCKET // 4 and not any(centre @ c >= apart for c in out):
            out.append(centre)
    return np.array(out).reshape(len(out), sample.shape[1])


def dense_balls(nodes: DataFrame, kind: str, total: int, width: int, first: int) -> Balls:
    """Leaders for the dense groups of ``nodes``; what comes to the driver is bounded by LEADERS."""
    least = max(DENSE, total // LEADERS)
    sign = np.random.default_rng(3).choice([-1.0, 1.0], (width, SIGNS))
    power = 1 << np.arange(SIGNS)

    def buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in arrow_batches(batches, 4096):
            yield pa.RecordBatch.from_pydict({"bucket": ((units(b.column("vec"), kind) @ sign) > 0) @ power})

    # least * LEADERS rows are more than there are, so no more than LEADERS buckets come
    hot = {r.bucket: r["count"] for r in nodes.select("vec").mapInArrow(buckets, "bucket long").groupBy("bucket").count().where(F.col("count") >= least).collect()}
    none = Balls(np.zeros((0, width)), first)
    if not hot:
        return none

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in arrow_batches(batches, 4096):
            of = ((units(b.column("vec"), kind) @ sign) > 0) @ power
            share = np.array([PER_BUCKET / hot[k] if k in hot else 0.0 for k in of.tolist()])
            take = np.flatnonzero(_share(b.column("mark").to_numpy()) < share)
            yield pa.RecordBatch.from_arrays([b.column("vec").take(pa.array(take)), pa.array(of[take])], ["vec", "bucket"])

    found = nodes.select("vec", "mark").mapInArrow(some, "vec binary, bucket long").toArrow()
    balls = Balls(_leaders(hot, units(found.column("vec"), kind), found.column("bucket").to_numpy()), first)
    if not len(balls.leaders):
        return none
    m = len(balls.leaders)

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, count, least = np.zeros(m, np.int64), np.zeros(m, np.int64), np.ones(m)
        for b in arrow_batches(batches, 4096):
            own, cosine = balls.own(units(b.column("vec"), kind))
            at = np.flatnonzero(own >= 0)
            own, cosine = own[at], cosine[at, own[at]]
            np.add.at(weight, own, b.column("n").to_numpy()[at])
            np.add.at(count, own, 1)
            np.minimum.at(least, own, cosine)
        k = np.flatnonzero(count)
        yield pa.RecordBatch.from_pydict({"ball": k, "weight": weight[k], "nodes": count[k], "least": least[k]})

    balls.weight, balls.nodes, balls.radius = np.zeros(m, np.int64), np.zeros(m, np.int64), np.zeros(m)
    each = nodes.select("vec", "n").mapInArrow(sizes, "ball long, weight long, nodes long, least double")
    for r in each.groupBy("ball").agg(F.sum("weight").alias("weight"), F.sum("nodes").alias("nodes"), F.min("least").alias("least")).collect():
        balls.weight[r.ball], balls.nodes[r.ball], balls.radius[r.ball] = r.weight, r.nodes, math.acos(r.least)
    return balls


def placed(nodes: DataFrame, kind: str, balls: Balls) -> DataFrame:
    """(node, n, ball, links, whole, rim): ball numbers from ``first``; links counts the own ball or copies and whole balls."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = np.append(balls.weight, 0)
        for b in arrow_batches(batches, 4096):
            own, whole, rim = balls.relations(units(b.column("vec"), kind))
            n = b.column("n").to_numpy()
            links = np.where(own >= 0, weight[own], n) - 1 + whole.astype(np.int64) @ balls.weight
            lists = [pa.array([(np.flatnonzero(x) + balls.first).tolist() for x in some], pa.list_(pa.int64())) for some in (whole, rim)]
            yield pa.RecordBatch.from_arrays([b.column("node"), b.column("n"), pa.array(np.where(own >= 0, own + balls.first, -1)), pa.array(links), *lists], ["node", "n", "ball", "links", "whole", "rim"])

    return nodes.select("node", "n", "vec").mapInArrow(run, "node long, n long, ball long, links long, whole array<long>, rim array<long>")


def rim_links(nodes: DataFrame, kind: str, balls: Balls, rim: dict[int, int]) -> DataFrame:
    """(node, links, ball): links across the rims of balls; ``ball`` is one that the node links with, if any. rim: nodes that may link, by ball."""
    chunks = {h: -(-int(balls.nodes[h - balls.first]) // SHARD) for h in rim}
    parts = {h: -(-n // SHARD) for h, n in rim.items()}

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in arrow_batches(batches, 4096):
            own, _, near = balls.relations(units(b.column("vec"), kind))
            out = []
            for k, mark in enumerate(mix(b.column("mark").to_numpy().view(np.uint64)).tolist()):
                mine = int(own[k]) + balls.first if own[k] >= 0 else -1
                if mine in chunks:
                    out += [(k, mine, mark % chunks[mine], p, True, mine) for p in range(parts[mine])]
                for h in (np.flatnonzero(near[k]) + balls.first).tolist():
                    out += [(k, h, c, mark % parts[h], False, mine) for c in range(chunks[h])]
            if out:
                at, *keys = zip(*out, strict=True)
                taken = b.select(["node", "n", "vec"]).take(pa.array(at))
                yield pa.RecordBatch.from_arrays([*taken.columns, *(pa.array(x) for x in keys)], ["node", "n", "vec", "at", "chunk", "part", "inside", "own"])

    def verify(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("node")
        x, n, node = units(rows.column("vec"), kind), rows.column("n").to_numpy(), rows.column("node").to_numpy()
        inside, own = rows.column("inside").to_numpy(), rows.column("own").to_numpy()
        member, other = np.flatnonzero(inside), np.flatnonzero(~inside)
        links, linked = np.zeros(len(node), np.int64), np.zeros(len(node), bool)
        for k in range(0, len(other), 1024):
            part = other[k : k + 1024]
            hit = x[part] @ x[member].T >= LINK
            links[part] += hit @ n[member]
            linked[part] = hit.any(axis=1)
            # a member of another ball counts its links itself, in its own relation to this one
            alone = own[part] < 0
            links[member] += n[part[alone]] @ hit[alone]
        ball = np.full(len(node), rows.column("at")[0].as_py()) if len(node) else np.zeros(0, np.int64)
        keep = links > 0
        return pa.table({"node": node[keep], "links": links[keep], "ball": pa.array(ball[keep], mask=~linked[keep])})

    dealt = nodes.select("node", "n", "vec", "mark").mapInArrow(deal, "node long, n long, vec binary, at long, chunk long, part long, inside boolean, own long")
    return dealt.groupBy("at", "chunk", "part").applyInArrow(verify, "node long, links long, ball long")


# Shards


def centres_of(singles: DataFrame, kind: str, count: int, k: int) -> np.ndarray:
    """k clustered centres, fitted on about PER_CENTRE nodes for each."""
    share = PER_CENTRE * k / count

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in arrow_batches(batches, 4096):
            take = np.flatnonzero(_share(~b.column("mark").to_numpy()) < share)
            yield pa.RecordBatch.from_arrays([b.column("vec").take(pa.array(take)), b.column("node").take(pa.array(take))], ["vec", "node"])

    x = units(singles.select("vec", "node", "mark").mapInArrow(some, "vec binary, node long").toArrow().sort_by("node").column("vec"), kind).astype(np.float32)
    if len(x) <= k:
        return x
    centre = x[np.random.default_rng(4).choice(len(x), k, replace=False)]
    for _ in range(6):
        own = np.argmax(x @ centre.T, axis=1)
        total = np.zeros_like(centre)
        np.add.at(total, own, x)
        size = np.linalg.norm(total, axis=1)
        centre = np.where(size[:, None] > 1e-6, total / np.maximum(size, 1e-6)[:, None], centre)
    return centre


def with_homes(nodes: DataFrame, kind: str, balls: Balls, centre: np.ndarray, overlap: int) -> DataFrame:
    """Nodes in no ball, with the nearest centres: (NODE, homes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in arrow_batches(batches, 4096):
            x = units(b.column("vec"), kind)
            alone = np.flatnonzero(balls.own(x)[0] < 0)
            homes = np.tile(np.arange(len(centre)), (len(alone), 1))
            if len(centre) > overlap:
                homes = np.argsort(-(x[alone].astype(np.float32) @ centre.T), axis=1, kind="stable")[:, :overlap]
            taken = b.select(["node", "n", "vec", "mark"]).take(pa.array(alone))
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(np.sort(homes, axis=1).tolist(), pa.list_(pa.int64()))], ["node", "n", "vec", "mark", "homes"])

    return nodes.select("node", "n", "vec", "mark").mapInArrow(run, f"{NODE}, homes array<long>")


def dealt(homed: DataFrame, chunks: dict[int, int]) -> DataFrame:
    """A row for each shard of a node: (home, lo, hi) name it; ``chunk`` is the node's, of ``chunks``. Other columns as they are.

    A home of one chunk is a shard. Of more, each pair of chunks is one; two nodes of
    one chunk count in its pair with the next.
    """
    names = homed.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in arrow_batches(batches, 4096):
            out = []
            marks = mix(b.column("mark").to_numpy().view(np.uint64)).tolist()
            for k, (mark, homes) in enumerate(zip(marks, b.column("homes").to_pylist(), strict=True)):
                for h in homes:
                    m = chunks[h]
                    c = mark % m
                    out += [(k, h, min(c, j), max(c, j), c, m) for j in range(m) if j != c or m == 1]
            if out:
                at, *keys = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([*b.take(pa.array(at)).columns, *(pa.array(x) for x in keys)], [*names, "home", "lo", "hi", "chunk", "chunks"])

    kinds = "home long, lo long, hi long, chunk long, chunks long"
    return homed.mapInArrow(run, T.StructType([*homed.schema, *T._parse_datatype_string(kinds)]))


def _built(kind: str):
    def build(rows: pa.Table) -> pa.Table:
        """The neighbours of each node of a shard."""
        rows = rows.sort_by("node")
        node = rows.column("node").to_numpy()
        adj = ShardGraph(units(rows.column("vec"), kind)).build()
        real = adj < len(node)
        ends = np.concatenate([[0], np.cumsum(real.sum(axis=1))]).astype(np.int32)
        return pa.table({"node": node, "neighbours": pa.ListArray.from_arrays(pa.array(ends), pa.array(node[adj[real]]))})

    return build


def _united(node: np.ndarray, lists: pa.ChunkedArray) -> np.ndarray:
    """Neighbours as places in ``node`` (sorted), padded; those of other shards alone are left out."""
    lists = lists.combine_chunks()
    count = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat, row = lists.flatten().to_numpy(), np.repeat(np.arange(len(node)), count)
    at = np.minimum(np.searchsorted(node, flat), len(node) - 1)
    keep = node[at] == flat
    at, row = at[keep], row[keep]
    per = np.bincount(row, minlength=len(node))
    out = np.full((len(node), max(1, int(per.max(initial=0)))), len(node), np.int32)
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(per) - per, per)] = at
    return out


def _roots(linked: np.ndarray) -> np.ndarray:
    """The smallest place of each one's component."""
    label = np.arange(len(linked))
    while True:
        new = label.copy()
        for k in range(0, len(linked), BATCH):
            some = linked[k : k + BATCH] > 0
            new[k : k + BATCH] = np.minimum(new[k : k + BATCH], np.where(some, label[None, :], len(linked)).min(axis=1))
        np.minimum.at(new, label, new.copy())  # a representative follows its members
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _searched(kind: str):
    def search(rows: pa.Table) -> pa.Table:
        """(node, links, least): verified links counted in this shard, and the smallest node of its component here."""
        rows = rows.sort_by("node")
        node, n, chunk = (rows.column(c).to_numpy() for c in ("node", "n", "chunk"))
        home, lo, hi, chunks = (rows.column(c)[0].as_py() for c in ("home", "lo", "hi", "chunks"))
        homes = np.array(rows.column("homes").to_pylist(), np.int64)
        x = units(rows.column("vec"), kind)
        graph = ShardGraph(x, _united(node, rows.column("neighbours")))
        linked = np.zeros((len(node), len(node)), np.uint8)  # 1: linked, 3: and counted here
        before = np.where(homes < home, homes, -1)
        for k in range(0, len(node), BATCH):
            at, v = graph.within(np.arange(k, min(k + BATCH, len(node)), dtype=np.int32), LINK)
            at = at + k
            keep = np.einsum("ij,ij->i", x[at], x[v]) >= LINK
            at, v = at[keep], v[keep]
            earlier = np.zeros(len(at), bool)
            for i in range(homes.shape[1]):
                earlier |= ((before[at, i][:, None] == homes[v]) & (before[at, i] >= 0)[:, None]).any(axis=1)
            same = chunk[at]
            # two nodes of one chunk meet in all its pairs: the one with the next chunk counts them
            elsewhere = (same == chunk[v]) & ((np.minimum(same, (same + 1) % chunks) != lo) | (np.maximum(same, (same + 1) % chunks) != hi))
            value = np.where(earlier | elsewhere, 1, 3).astype(np.uint8)
            linked[at, v] |= value
            linked[v, at] |= value
        links = np.concatenate([(linked[k : k + BATCH] == 3) @ n for k in range(0, len(node), BATCH)])
        root = _roots(linked)
        keep = linked.any(axis=1)
        return pa.table({"node": node[keep], "links": links[keep], "least": node[root[keep]]})

    return search


def graph_links(nodes: DataFrame, kind: str, balls: Balls, total: int, overlap: int) -> DataFrame:
    """(node, links, least) of nodes in no ball, a row for each shard in which a node has links."""
    count = total - int(balls.nodes.sum())
    k = min(CENTRES, max(1, -(-count * overlap // SHARD)))
    if count <= SHARD:
        k = 1
    one = with_homes(nodes, kind, balls, np.zeros((1, 1)), overlap)
    centre = centres_of(one, kind, count, k) if k > 1 else np.zeros((1, 1))
    homed = written((with_homes(nodes, kind, balls, centre, overlap) if k > 1 else one), "neardup-homes")
    size = {r.home: r["count"] for r in homed.select(F.explode("homes").alias("home")).groupBy("home").count().collect()}
    chunks = {h: 1 if c <= 1.5 * SHARD else max(2, -(-4 * c // (3 * SHARD))) for h, c in size.items()}
    shards = dealt(homed, chunks)
    lists = shards.groupBy("home", "lo", "hi").applyInArrow(_built(kind), "node long, neighbours array<long>")
    united = lists.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("neighbours"))).alias("neighbours"))
    return dealt(homed.join(united, "node"), chunks).groupBy("home", "lo", "hi").applyInArrow(_searched(kind), "node long, links long, least long")


# All together


def audit(nodes: DataFrame, counted: DataFrame, kind: str, total: int) -> float:
    """The share of the links of about AUDIT nodes, as brute force over all nodes finds them, that ``counted`` (node, links) has."""
    share = AUDIT / max(total, 1)

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in arrow_batches(batches, 4096):
            take = pa.array(np.flatnonzero(_share(b.column("mark").to_numpy() ^ np.int64(0x5555)) < share))
            yield b.select(["node", "n", "vec"]).take(take)

    asked = nodes.select("node", "n", "vec", "mark").mapInArrow(some, "node long, n long, vec binary").toArrow()
    if not asked.num_rows:
        return 1.0
    q, ids = units(asked.column("vec"), kind), asked.column("node").to_numpy()

    def brute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(len(q), np.int64)
        for b in arrow_batches(batches, 4096):
            hit = units(b.column("vec"), kind) @ q.T >= LINK
            hit |= b.column("node").to_numpy()[:, None] == ids[None, :]
            found += b.column("n").to_numpy() @ hit
        yield pa.RecordBatch.from_pydict({"node": ids, "links": found})

    true = {r.node: r.links - 1 for r in nodes.select("node", "n", "vec").mapInArrow(brute, "node long, links long").groupBy("node").agg(F.sum("links").alias("links")).collect()}
    chosen = nodes.sparkSession.createDataFrame([(int(i),) for i in ids], "node long")
    found = {r.node: r.links for r in counted.join(F.broadcast(chosen), "node").select("node", "links").collect()}
    every = sum(true.values())
    return sum(min(true[i], found.get(i, 0)) for i in true) / every if every else 1.0


def _unit(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return F.broadcast(spark.createDataFrame(rows, schema))


def _linked(nodes: DataFrame, kind: str, total: int, width: int, first: int) -> tuple[DataFrame, DataFrame, float]:
    """Of nodes of one length: (node, key, links), links (u, v) between keys, and the recall. A ball's key is below zero."""
    spark = nodes.sparkSession
    key = lambda ball: -1 - ball
    balls = dense_balls(nodes, kind, total, width, first)
    base = written(placed(nodes, kind, balls), "neardup-placed")
    more, edges = [], []
    if len(balls.leaders):
        own = F.when(F.col("ball") >= 0, key(F.col("ball"))).otherwise(F.col("node"))
        whole = base.select("n", "ball", own.alias("u"), F.explode("whole").alias("at"))
        edges.append(whole.select("u", key(F.col("at")).alias("v")).distinct())
        given = {r["at"]: r.n for r in whole.where("ball < 0").groupBy("at").agg(F.sum("n").alias("n")).collect()}
        if given:
            more.append(base.join(_unit(spark, list(given.items()), "ball long, given long"), "ball").select("node", F.col("given").alias("links")))
        rim = {r["at"]: r["count"] for r in base.select(F.explode("rim").alias("at")).groupBy("at").count().collect()}
        if rim:
            across = written(rim_links(nodes, kind, balls, rim), "neardup-rim")
            more.append(across.select("node", "links"))
            edges.append(across.where("ball is not null").join(base.select("node", own.alias("u")), "node").select("u", key(F.col("ball")).alias("v")).distinct())
    overlap, best = OVERLAP, None
    for _ in range(ROUNDS):
        found = written(graph_links(nodes, kind, balls, total, overlap), "neardup-links")
        extra = found.select("node", "links")
        for part in more:
            extra = extra.unionByName(part)
        counted = base.join(extra.groupBy("node").agg(F.sum("links").alias("more")), "node", "left")
        counted = written(counted.select("node", F.when(F.col("ball") >= 0, key(F.col("ball"))).otherwise(F.col("node")).alias("key"), (F.col("links") + F.coalesce("more", F.lit(0))).alias("links")), "neardup-counts")
        links = found.where("node != least").select(F.col("node").alias("u"), F.col("least").alias("v"))
        for part in edges:
            links = links.unionByName(part)
        recall = audit(nodes, counted, kind, total)
        if best is None or recall > best[2]:
            best = (counted, links, recall)
        if recall >= RECALL or total <= SHARD:
            break
        overlap *= 2
    return best


@dataclass
class Result:
    """``rows``: (vec_id, n_links, component_id, kept) for each row; ``recall``: of the audit, the least of all lengths."""

    rows: DataFrame
    recall: float


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> Result:
    """Count links and find components of all rows of ``vectors``."""
    given, kind = rows_of(vectors, id_col, vec_col)
    same = given.where("digest is not null").groupBy("digest", "vec").agg(F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("least"))
    nodes = written(same.withColumn("node", F.monotonically_increasing_id()).withColumn("mark", F.xxhash64("digest")), "neardup-nodes")
    found = nodes.groupBy(F.octet_length("vec").alias("size")).count().orderBy("size").limit(LENGTHS + 1).collect()
    if len(found) > LENGTHS:
        raise ValueError(f"vectors of over {LENGTHS} lengths")
    parts, links, recall = [], [], 1.0
    for k, (size, total) in enumerate(found):
        of = nodes.where(F.octet_length("vec") == size)
        counted, some, heard = _linked(of, kind, total, size // np.dtype(kind).itemsize, k * LEADERS)
        parts.append(counted)
        links.append(some)
        recall = min(recall, heard)
    if recall < RECALL:
        warnings.warn(f"the audit found {recall:.3f} of the links", stacklevel=2)
    blank = given.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), "digest")
    out = blank.where("digest is null").drop("digest")
    if parts:
        counted, edges = parts[0], links[0]
        for other, more in zip(parts[1:], links[1:], strict=True):
            counted, edges = counted.unionByName(other), edges.unionByName(more)
        joined = counted.join(stars(edges).select(F.col("u").alias("key"), F.col("v").alias("root")), "key", "left").select("node", "links", F.coalesce("root", "key").alias("root"))
        named = written(joined.join(nodes.select("node", "digest", "least"), "node"), "neardup-named")
        ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
        whole = named.join(ids, "root").select("digest", F.col("links").alias("n_links"), "component_id")
        out = given.where("digest is not null").select("vec_id", "digest").join(whole, "digest").select("vec_id", "n_links", "component_id").unionByName(out)
    return Result(out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False))), recall)


def report(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    return near_duplicates(vectors, id_col, vec_col).rows


def deduplicate(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """The rows of ``vectors`` whose id names their component, columns as they are; null ids go."""
    kept, name = report(vectors, id_col, vec_col).where("kept").select("vec_id").distinct(), free_name(vectors, "kept_id")
    return vectors.join(kept.withColumnRenamed("vec_id", name), F.col(id_col) == F.col(name), "left_semi")
