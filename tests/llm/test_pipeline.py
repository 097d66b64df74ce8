import hashlib
import os
import re
import threading

import public_tokenizers
import pyarrow as pa
import tiktoken

import corpus_pipeline
from cases import SF
from foliant.llm import bpe, queries, secretscan, session
from test_decontam import brute as brute_hits
from test_simhash import brute_components, plain_fingerprint


def test_run_equals_plain_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    good = sorted(r.doc_id for r in queries.op2_quality(spark, SF).collect() if r.predicted)
    assert 0 < len(good) < len(texts)
    of = brute_components([(i, plain_fingerprint(texts[i])) for i in good])
    single = [i for i, c in zip(good, of, strict=True) if i == c]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = [r[0] for r in brute_hits([(i, texts[i]) for i in single], items, 13) if not r[-1]]
    kept = docs.where(docs.doc_id.isin(clean))
    field = secretscan.fit(kept)
    spans = secretscan.scan(pa.array([texts[i] for i in clean]), field)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    want = {}
    for i, found in zip(clean, spans, strict=True):
        out, at = "", 0
        for _, a, b in found:
            if a >= at:
                out += texts[i][at:a] + "[SECRET]"
            at = max(at, b)
        want[i] = out + texts[i][at:]
    at = session.shared_dir(spark).removeprefix("file:")
    before = {f for f in os.listdir(at) if "-" in f}
    got = corpus_pipeline.run(spark, SF).collect()
    assert [f.split("-")[0] for f in set(os.listdir(at)) - before if re.match(r"[a-z]+-", f)] == ["pipeline"]
    assert {r.doc_id: r.ids for r in got} == {i: library.encode_ordinary(t) for i, t in want.items()}
    assert all(r.decoded_sha256 == hashlib.sha256(want[r.doc_id].encode()).hexdigest() for r in got)


def test_stages_take_odd_and_no_rows(spark, odd_docs):
    for rows in (odd_docs, odd_docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            got = stage(spark, rows, SF)
            assert name == "byte-level BPE" or got.columns == rows.columns
            assert got.count() <= rows.count()


def test_two_pipelines_in_two_threads(spark):
    """Neither deletes what the other one reads."""
    want, got = {(r.doc_id, r.ids_sha256) for r in corpus_pipeline.run(spark, SF).collect()}, []

    def one():
        got.append({(r.doc_id, r.ids_sha256) for r in corpus_pipeline.run(spark, SF).collect()})

    threads = [threading.Thread(target=one) for _ in range(2)]
    for t in threads:
        t.start()
    for t in threads:
        t.join(300)
    assert got == [want, want]
