import hashlib
import math
import re
import zlib

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from cases import SF
from foliant.llm import resample

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def grams(text, order=2):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return w, [" ".join(w[i : i + k]) for k in range(1, order + 1) for i in range(len(w) - k + 1)]


def buckets(text, order=2):
    return sorted(zlib.crc32(g.encode()) % 10_000 for g in grams(text, order)[1])


def brute(docs, target):
    """The contract written out, row by row. docs: (doc_id, text)."""
    count = {side: np.zeros(10_000, int) for side in ("s", "t")}
    for side, texts in (("s", [t for _, t in docs]), ("t", target)):
        for t in texts:
            for b in buckets(t):
                count[side][b] += 1
    big_s, big_t = int(count["s"].sum()), int(count["t"].sum())
    gain = [math.floor(1000 * math.log((t + 1) * (big_s + 10000) / ((s + 1) * (big_t + 10000)))) for s, t in zip(count["s"].tolist(), count["t"].tolist(), strict=True)]
    rows = []
    for i, text in docs:
        found = buckets(text)
        weight = sum(gain[b] for b in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(grams(text)[0])])
    enough = sorted((r for r in rows if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0]))
    for k, r in enumerate(enough[: 25 * len(enough) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in rows), key=str)


def rows(df):
    assert df.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert {kind for _, kind in df.dtypes[1:]} == {"bigint"}
    return sorted(map(tuple, df.collect()), key=str)


def test_documents(spark):
    docs, bench = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    assert rows(resample.report(docs, bench)) == brute([(r.doc_id, r.text) for r in docs.collect()], [r.text for r in bench.collect()])


def test_odd_rows(spark, odd_docs):
    docs, target = [(r.doc_id, r.text) for r in odd_docs.collect()], [None, "", "a b a b wide", "a b a b wide"]
    bench = spark.createDataFrame([(t,) for t in target], "text string")
    assert rows(resample.report(odd_docs, bench)) == brute(docs, target)
    assert rows(resample.report(odd_docs, bench.limit(0))) == brute(docs, [])
    assert rows(resample.report(odd_docs.limit(0), bench)) == []
    kept = resample.resample(odd_docs, bench)
    assert kept.columns == odd_docs.columns and kept.count() == 25 * 2 // 100


def test_copies_and_ties(spark):
    """A third of the rows share one text, a third one id as well; equal rows are drawn one by one."""
    same, other = "one two three four five " * 6, "six seven eight nine ten " * 5
    docs = [(k, same) for k in range(40)] + [(7, other)] * 40 + [(k, f"word{k} " * 25) for k in range(100, 140)] + [(None, same)] * 3
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    bench = spark.createDataFrame([(other,)], "text string")
    want = brute(docs, [other])
    assert rows(resample.report(df, bench)) == want
    n = sum(r[4] is not None for r in want)
    assert n == 25 * 123 // 100
    assert sorted((r.doc_id for r in resample.resample(df, bench).collect()), key=str) == sorted((r[0] for r in want if r[4]), key=str)
    assert resample.distinct_features(df).count() == 42


@settings(max_examples=60, deadline=None)
@given(st.lists(st.none() | st.text(alphabet="ab Z9é日-\n", max_size=40) | st.sampled_from(["w" * 200 + " x", "a" * 64 + " " + "b" * 65, "x " * 50]), max_size=6), st.integers(1, 4))
def test_hashes_of_a_batch(texts, order):
    found, words, count = resample.feature_buckets(pa.array(texts, pa.string()), order)
    at = np.concatenate([[0], np.cumsum(count)])
    assert [found[i:j].tolist() for i, j in zip(at[:-1], at[1:], strict=True)] == [buckets(t, order) for t in texts]
    assert words.tolist() == [len(grams(t)[0]) for t in texts]
    packed = resample._packed(found, count)
    for part in (packed, packed.slice(1), packed.slice(0, 1)):
        back, n = resample._unpacked(part)
        cut = slice(*{0: (0, None), 1: (at[min(1, len(texts))], None)}[part.offset]) if len(part) == len(packed) - part.offset else slice(0, at[1])
        assert back.tolist() == found[cut].tolist() and n.sum() == len(back)
