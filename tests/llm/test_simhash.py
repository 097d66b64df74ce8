import random

import xxhash

from cases import SF
from foliant.llm import graph, simhash


def plain_fingerprint(text):
    w = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x) for x in __import__("re").findall(r"[^\x20\x09-\x0D]+", text or "")]
    if not w:
        return 0
    grams = [" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(rows):
    """rows (id, fp) to {position: smallest id}."""
    parent = list(range(len(rows)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            if (rows[a][1] ^ rows[b][1]).bit_count() <= 3:
                parent[root(a)] = root(b)
    groups = {}
    for k, (i, _) in enumerate(rows):
        groups.setdefault(root(k), []).append(i)
    return [min((i for i in groups[root(k)] if i is not None), default=None) for k in range(len(rows))]


def expected(rows):
    prints = [(i, plain_fingerprint(t)) for i, t in rows]
    return sorted(((i, f"{p:016x}", c) for (i, p), c in zip(prints, brute_components(prints), strict=True)), key=str)


def test_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert sorted(map(tuple, simhash.report(docs).collect()), key=str) == expected([(r.doc_id, r.text) for r in docs.collect()])


def test_odd_rows(spark, odd_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    assert sorted(map(tuple, simhash.report(odd_docs).collect()), key=str) == expected(rows)
    assert simhash.report(odd_docs.limit(0)).count() == 0
    kept = simhash.deduplicate(odd_docs)
    assert kept.columns == odd_docs.columns
    assert kept.count() == len({c for _, _, c in expected(rows)})
    assert simhash.deduplicate(odd_docs.limit(0)).count() == 0


def test_clusters_in_whole_and_cut_buckets(spark):
    rng = random.Random(5)
    centre = [rng.getrandbits(64) for _ in range(3)]
    prints = list({c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for c in centre for _ in range(120)} | {rng.getrandbits(64) for _ in range(50)})
    nodes = spark.createDataFrame([(simhash._signed(p),) for p in prints], "fp long")
    want = brute_components(list(enumerate(prints)))
    held = simhash.BUCKET
    for size in (held, 20):
        simhash.BUCKET = size
        try:
            got = {r.fp: r.root for r in simhash.components(nodes).collect()}
        finally:
            simhash.BUCKET = held
        roots = [got[simhash._signed(p)] for p in prints]
        assert len(set(zip(roots, want, strict=True))) == len(set(roots)) == len(set(want))


def test_chain_of_components(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, 101), (101, 102)], "u long, v long")
    assert {(r.u, r.v) for r in graph.stars(links).collect()} == {(k, 0) for k in range(1, 61)} | {(101, 100), (102, 100)}
