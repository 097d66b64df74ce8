import numpy as np
import pytest
from pyspark.sql import functions as F

from cases import SF
from foliant.llm import neardup, vectorgraph


def brute(rows):
    """rows (id, vector) to (id, links, component, kept), all pairs compared."""
    def unit(v):
        if v is None or not len(v) or any(x is None for x in v) or not np.isfinite(np.array(v, float)).all() or not np.any(v):
            return None
        x = np.array(v, float) / np.abs(np.array(v, float)).max()
        return x / np.linalg.norm(x)

    x = [unit(v) for _, v in rows]
    n = len(rows)
    linked = np.zeros((n, n), bool)
    for size in {len(v) for v in x if v is not None}:
        at = [k for k, v in enumerate(x) if v is not None and len(v) == size]
        m = np.stack([x[k] for k in at])
        linked[np.ix_(at, at)] = m @ m.T >= 0.9
    np.fill_diagonal(linked, False)
    label = list(range(n))
    for _ in range(n):
        new = [min([label[k], *(label[j] for j in np.flatnonzero(linked[k]).tolist())]) for k in range(n)]
        if new == label:
            break
        label = new
    ids = {}
    for k, c in enumerate(label):
        ids.setdefault(c, []).append(rows[k][0])
    least = {c: min((i for i in some if i is not None), default=None) for c, some in ids.items()}
    return sorted(((i, int(linked[k].sum()), least[label[k]], i is not None and i == least[label[k]]) for k, (i, _) in enumerate(rows)), key=str)


def table(spark, rows, kind="float"):
    return spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").repartition(3)


def got(df):
    assert df.columns == ["vec_id", "n_links", "component_id", "kept"]
    return sorted(map(tuple, df.collect()), key=str)


def near(rng, x, least, most):
    """Vectors beside unit vectors x, at a cosine between least and most."""
    r = rng.normal(size=x.shape)
    r -= (r * x).sum(axis=1)[:, None] * x
    r /= np.linalg.norm(r, axis=1)[:, None]
    c = rng.uniform(least, most, (len(x), 1))
    return c * x + np.sqrt(1 - c * c) * r


def made(seed, n, d=64):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d))
    return rng, x / np.linalg.norm(x, axis=1)[:, None]


def as_rows(x):
    return [(k, [float(v) for v in np.float32(row)]) for k, row in enumerate(x)]


def test_table(spark):
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet")
    assert got(neardup.report(vectors)) == brute([(r.vec_id, r.embedding) for r in vectors.collect()])


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (2, [1.0, 0.0]), (None, [1.0, 0.01]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [None, 1.0]), (7, [nan, 1.0]), (8, [inf, 1.0]), (9, [-1.0, -0.0]), (10, [-1.0, 0.0]), (11, [1e-300, 0.0]), (12, [1e300, 1e300]), (None, None), (13, [1.0, 0.0, 0.0]), (14, [1.0, 0.0, 0.1]), (15, [5.0]), (16, [-5.0]), (None, [0.0, 1.0])]
    for kind in ("double", "float"):
        some = [r for r in rows if kind == "double" or r[0] not in (11, 12)]
        df = table(spark, some, kind).withColumns({"digest": F.lit("x"), "n": F.lit(1), "kept_id": F.lit(2), "VEC": F.lit(0)})
        want = brute(some)
        assert got(neardup.report(df)) == want
        kept = neardup.deduplicate(df)
        assert kept.columns == df.columns and sorted(r.vec_id for r in kept.collect()) == sorted(r[0] for r in want if r[3])
    assert got(neardup.report(table(spark, []))) == []
    with pytest.raises(ValueError):
        neardup.report(table(spark, [(k, [1.0] * (k + 1)) for k in range(neardup.LENGTHS + 1)]))


def test_copies_and_a_dense_group(spark):
    """A third of the rows are copies, a third near copies of one vector; some lie on the rim of that group."""
    rng, x = made(1, 200)
    centre = x[:1]
    tight = near(rng, np.repeat(centre, 300, axis=0), 0.985, 0.999)
    rim = near(rng, np.repeat(centre, 60, axis=0), 0.87, 0.97)
    other = near(rng, near(rng, centre, 0.9, 0.9).repeat(120, axis=0), 0.985, 0.999)
    rows = as_rows(np.concatenate([x, tight, rim, other, np.repeat(x[5:6], 250, axis=0)]))
    rng.shuffle(rows)
    df = table(spark, [(int(i), v) for i, v in rows])
    result = neardup.near_duplicates(df)
    assert result.recall == 1.0
    assert got(result.rows) == brute(rows)
    given, kind = neardup.rows_of(df, "vec_id", "embedding")
    nodes = given.groupBy("digest", "vec").agg(F.count("*").alias("n")).withColumn("mark", F.xxhash64("digest")).withColumn("node", F.monotonically_increasing_id())
    balls = neardup.dense_balls(nodes, kind, nodes.count(), 64, 0)
    assert balls.nodes.sum() > 300  # near copies are counted as balls


def test_shards_chunks_and_chains(spark, monkeypatch):
    """Many small shards, cut ones among them: every pair is counted once."""
    rng, x = made(2, 900, 16)
    mates = near(rng, x[:300], 0.9, 0.999)
    chain = [x[0]]
    for _ in range(40):
        chain.append(near(rng, chain[-1][None], 0.92, 0.95)[0])
    wide = near(rng, np.repeat(x[1:2], 150, axis=0), 0.93, 0.96)
    rows = as_rows(np.concatenate([x, mates, np.array(chain), wide]))
    want = brute(rows)
    links = sum(r[1] for r in want)
    df = table(spark, rows)
    for shard, centres in ((256, 64), (128, 3)):
        monkeypatch.setattr(neardup, "SHARD", shard)
        monkeypatch.setattr(neardup, "CENTRES", centres)
        monkeypatch.setattr(neardup, "DENSE", 10**6)
        found = got(neardup.report(df))
        assert [r[0] for r in found] == [r[0] for r in want]
        assert all(a[1] <= b[1] for a, b in zip(found, want, strict=True))  # none below the bound, none twice
        assert sum(r[1] for r in found) >= 0.97 * links
        assert sum(a[2] == b[2] for a, b in zip(found, want, strict=True)) >= 0.97 * len(want)


def test_graph_of_a_shard():
    rng, x = made(3, 1500)
    x[1000:1400] = near(rng, x[:400], 0.9, 0.99)
    graph = vectorgraph.ShardGraph(x)
    adj = graph.build()
    assert adj.shape == (1500, vectorgraph.DEGREE) and all(len(set(r[r < 1500].tolist())) == (r < 1500).sum() and k not in r for k, r in enumerate(adj))
    s = x @ x.T
    np.fill_diagonal(s, 0)
    found = set()
    for k in range(0, 1500, 256):
        rows = np.arange(k, min(1500, k + 256), dtype=np.int32)
        at, v = graph.within(rows, 0.9)
        assert (s[rows[at], v] >= 0.9 - 2e-3).all()
        found |= set(zip(rows[at].tolist(), v.tolist(), strict=True))
    true = set(zip(*(a.tolist() for a in np.nonzero(s >= 0.9)), strict=True))
    assert len(true & found) >= 0.98 * len(true)


def test_roots():
    linked = np.zeros((600, 600), np.uint8)
    for a, b in [(k, k + 1) for k in range(0, 500, 1) if k % 100 != 99] + [(550, 3)]:
        linked[a, b] = linked[b, a] = 1
    want = [k - k % 100 if k < 500 else k for k in range(600)]
    want[500] = 500
    want[550] = 0
    assert neardup._roots(linked).tolist() == want
