import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cases import SF
from foliant.llm import tokenfiles

PATH = public_tokenizers.path("byte_bpe_50k.json")


def brute(df):
    """By the plain call of the library; rows of one id in order of their text's hash."""
    t = Tokenizer.from_file(PATH)
    start, out = 0, []
    for i, text, _ in sorted(df.select("doc_id", "text", F.xxhash64("text")).collect(), key=lambda r: (r[0] is not None, r[0] or 0, r[2])):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 70_000), st.integers(0, 2**64 - 1)), max_size=700))
def test_pack_round_trip(ids):
    words, offsets = tokenfiles.pack(np.array(ids, np.uint64))
    assert tokenfiles.unpack(words, offsets, len(ids)).tolist() == ids
    assert len(offsets) == -(-len(ids) // tokenfiles.BLOCK) + 1


def test_pack_is_dense():
    words, _ = tokenfiles.pack(np.ones(1280, np.uint64))
    assert len(words) <= 1280 / 128 * 3


def test_files_equal_the_library(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = tokenfiles.encode_files(docs, PATH).collect()
    assert sorted(map(tuple, got)) == brute(docs)


def test_odd_rows(odd_docs):
    got = tokenfiles.encode_files(odd_docs, PATH).collect()
    assert sorted(map(tuple, got), key=lambda r: r[1]) == brute(odd_docs)


def test_empty_table(odd_docs):
    assert tokenfiles.encode_files(odd_docs.limit(0), PATH).collect() == []


def test_ids_come_back(spark, odd_docs, tmp_path):
    tokenfiles.write(odd_docs.where("doc_id = 1"), f"file://{tmp_path}/x", PATH)
    rows = tokenfiles.read(spark, f"file://{tmp_path}/x", with_ids=True).collect()
    t = Tokenizer.from_file(PATH)
    assert [t.decode(r.ids[:-1]) for r in rows] == ["Hello world\nagain"] * 2


def test_added_tokens_as_the_library_has_them(spark):
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x <|endoftext|><|endoftext|>y z", "<|endof text|>", "plain <|", "endoftext|> plain"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(map(tuple, tokenfiles.encode_files(docs, PATH).collect()), key=lambda r: r[1]) == brute(docs)
    t = Tokenizer.from_file(PATH)
    got = tokenfiles.encode_files(docs, PATH, with_ids=True).collect()
    assert {r.doc_id: r.ids for r in got} == {k: [*t.encode(x, add_special_tokens=False).ids, 2] for k, x in enumerate(texts)}


def test_ids_of_any_type(spark):
    for rows, kind in (([("b", "x y"), (None, "n"), ("a", None)], "string"), ([(-(2**63), "x y"), (None, "n"), (2**63 - 1, None)], "long"), ([(1.5, "x"), (None, "n"), (-1.0, "y")], "double")):
        docs = spark.createDataFrame(rows, f"doc_id {kind}, text string")
        got = tokenfiles.encode_files(docs, PATH)
        assert dict(got.dtypes)["doc_id"] == dict(docs.dtypes)["doc_id"]
        first, *rest = (r.doc_id for r in sorted(got.collect(), key=lambda r: r.start))
        assert first is None and rest == sorted(r[0] for r in rows if r[0] is not None)


def test_a_hot_id_is_spread_over_ranges(spark, tmp_path):
    docs = spark.range(4000, numPartitions=4).select(F.when(F.col("id") % 3 > 0, F.lit(7)).otherwise(F.col("id")).alias("doc_id"), F.when(F.col("id") % 3 == 2, F.lit("same text")).otherwise(F.concat(F.lit("t "), F.col("id").cast("string"))).alias("text"))
    tokenfiles.write(docs, f"file://{tmp_path}/x", PATH, partitions=16)
    per = spark.read.parquet(f"file://{tmp_path}/x").groupBy("part").agg(F.sum(F.size("doc_ids")).alias("n")).collect()
    assert len(per) >= 14 and max(r.n for r in per) < 3 * 4000 / 16
    assert sorted(map(tuple, tokenfiles.read(spark, f"file://{tmp_path}/x").collect()), key=lambda r: r[1]) == brute(docs)
