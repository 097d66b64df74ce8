"""One text of two million characters beside small ones, through every operator."""

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from tokenizers import Tokenizer

from cases import SF
from foliant.llm import bpe, decontam, htmltext, langid, quality, rules, secretscan, simhash, tokenfiles, unigram
from test_rules import brute as brute_rules
from test_secretscan import brute as brute_secrets
from test_simhash import plain_fingerprint


@pytest.fixture(scope="module")
def long(spark):
    words = " ".join(r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect())
    return (words * (1 + 2_000_000 // len(words)))[:2_000_000]


@pytest.fixture(scope="module")
def docs(spark, long):
    return spark.createDataFrame([(1, long), (2, "short text"), (3, None)], "doc_id long, text string").repartition(2).cache()


def row(df):
    return df.where("doc_id = 1").first()


def test_counts_and_digests(docs, long):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ids = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(path), special_tokens={}).encode_ordinary(long)
    got = row(bpe.encode(docs, path, public_tokenizers.PATTERN))
    assert (got.n_tokens, got.ids_sha256, got.decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(long.encode()).hexdigest())
    path = public_tokenizers.path("byte_bpe_50k.json")
    ids = [*Tokenizer.from_file(path).encode(long, add_special_tokens=False).ids, 2]
    got = row(tokenfiles.encode_files(docs, path))
    assert (got.n_tokens, got.ids_crc32) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
    got = row(rules.report(docs, np.zeros(1 << rules.BITS)))
    assert (got.n_words, got.word_chars, got.n_symbols, got.n_dup_lines, got.n_repeat_words, got.base_failed) == brute_rules(long)
    assert row(simhash.report(docs)).fingerprint == f"{plain_fingerprint(long) & (1 << 64) - 1:016x}"
    assert row(unigram.count_tokens(docs, public_tokenizers.path("piece_bpe_32k.model"))).n_tokens > 200_000


def test_models_and_scans(spark, docs, long):
    field = secretscan.fit(docs.where("doc_id = 2"))
    got = row(secretscan.report(docs, field))
    assert (got.n_assign, got.n_access, got.n_hex, got.base_sha256) == brute_secrets(long)
    learn = spark.createDataFrame([(1, long[:5000], "a"), (2, "other words", "b")], "doc_id long, text string, lang string")
    assert row(langid.predict(docs, langid.fit(learn))).lang_pred == "a"
    assert 0 <= row(quality.with_score(docs, quality.Model(np.ones(quality.ROWS), 0.0), name="score")).score <= 1
    items = spark.createDataFrame([(7, long[1_000_000:1_000_300])], "item_id long, text string")
    got = row(decontam.report(docs, items))
    assert got.n_items == 1 and got.n_hit >= 13
    page = f"<body><nav>m</nav><div><p>{'</p><p>'.join(long[k : k + 500].replace('<', '') for k in range(0, len(long), 500))}</p></div>"
    assert len(htmltext.main_text(page)) > 1_900_000
