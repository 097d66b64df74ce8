import hashlib
import itertools
import os

import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from cases import ODD_TEXTS, SF
from foliant.llm import bpe, textbatch

PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.load_ranks(PATH), special_tokens={})


TREE = []


def tree():
    if not TREE:
        TREE.append(bpe.TreeBPE(bpe.load_ranks(PATH), PATTERN))
    return TREE[0]


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=300), st.text("abcdeinrst", min_size=20, max_size=600), st.text("aA ", max_size=400)))
def test_tree_equals_library(library, text):
    t = tree()
    assert t.text(text) == library.encode_ordinary(text)
    assert t.decode(t.text(text)) == text.encode()


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.binary(max_size=200), st.text("abcdeinrst ", max_size=60).map(str.encode)), st.one_of(st.binary(max_size=200), st.text("abcdeinrst ", max_size=60).map(str.encode)))
def test_join_is_the_encoding_of_both(library, a, b):
    t = tree()
    want = library._encode_single_piece(a + b) if a + b else []
    assert t.join(t.tree(a), t.tree(b)) == t.tree(a + b) == want
    assert t.decode(want) == a + b


@settings(max_examples=200, deadline=None)
@given(st.one_of(st.binary(max_size=120), st.text("aeinrst ", max_size=120).map(str.encode)))
def test_both_ways_to_merge(piece):
    t = tree()
    if piece:
        assert t._merge_short(piece) == t._merge_long(piece) == t.merge(piece)


def test_long_pieces(library):
    for text in ("x" * 50_000, "ab" * 20_000, "qwertz" * 5_000, "\u4e00" * 9_000, "=" * 9_001):
        assert tree().text(text) == library.encode_ordinary(text)


def test_a_token_that_merging_never_makes():
    ranks = {bytes((b,)): b for b in range(256)} | {b"abc": 256, b"bc": 257, b"xyz": 258}  # x y z has no pair to begin with
    t = bpe.TreeBPE(ranks, r"[a-z]+")
    own = tiktoken.Encoding("own", pat_str=r"[a-z]+", mergeable_ranks=ranks, special_tokens={})
    for text in ("abc", "xyz", "axyz", "xyzabcxyz", "abcabc"):
        assert t.text(text) == own.encode_ordinary(text)


def test_no_library_does_the_work():
    folder = os.path.dirname(bpe.__file__)
    assert not any("tiktoken" in line and "import" in line for name in os.listdir(folder) if name.endswith(".py") for line in open(os.path.join(folder, name)))


RUGGED = st.text(st.sampled_from("aZ\u00e9\u4e2d\u0301\u01c5 19\u0663\u00b2\u2167 ''strevmdlSRE .,-\u20ac\U0001f600\U0001d7ce\x00\x1c\x1f \t\n\r\x0b\x85\u00a0\u1680\u2003\u2028\u3000\ufeff"), max_size=40)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(RUGGED, st.text(max_size=30)), max_size=6))
def test_cut_is_that_of_the_pattern(texts):
    assert PATTERN == textbatch.USUAL
    buf, offsets = textbatch.text_bytes(pa.array(texts, pa.string()))
    starts, ends, count = textbatch.usual_pieces(buf, offsets)
    found = iter([buf[i:j].tobytes().decode() for i, j in zip(starts, ends, strict=True)])
    assert [[next(found) for _ in range(n)] for n in count] == [tree().matches(t) for t in texts]


def test_characters_are_cut_as_the_pattern_does():
    texts = [f"a{c}{c} {c}b {c}'s1{c}" for c in map(chr, [*range(0x3400), *range(0x3400, 0xD800, 37), *range(0xE000, 0x110000, 37)])]
    buf, offsets = textbatch.text_bytes(pa.array(texts, pa.string()))
    starts, ends, count = textbatch.usual_pieces(buf, offsets)
    want = [[len(m.encode()) for m in tree().matches(t)] for t in texts]
    assert (ends - starts).tolist() == [*itertools.chain(*want)] and (starts[1:] == ends[:-1]).all()
    assert count.tolist() == [len(x) for x in want]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.binary(max_size=90), st.text("abcdeinrst ", max_size=80).map(str.encode), st.text(" \u4e00\u00e9=", max_size=30).map(str.encode)), min_size=bpe.FEW, max_size=150))
def test_trees_grown_together_equal_the_library(library, pieces):
    ids, count = tree().pieces(pieces)
    assert count.sum() == len(ids)
    end = count.cumsum()
    assert [ids[e - n : e].tolist() for e, n in zip(end, count, strict=True)] == [library._encode_single_piece(p) if p else [] for p in pieces]


def test_trees_grown_together_with_tokens_that_merging_never_makes():
    ranks = {bytes((b,)): b for b in range(256)} | {b"abc": 256, b"bc": 257, b"xyz": 258, b"ca": 259}
    t = bpe.TreeBPE(ranks, r"[a-z]+")
    own = tiktoken.Encoding("own", pat_str=r"[a-z]+", mergeable_ranks=ranks, special_tokens={})
    pieces = ["".join(p).encode() for n in range(1, 5) for p in itertools.product("abcxyz", repeat=n)]
    ids, count = t.pieces(pieces)
    assert ids.tolist() == [i for p in pieces for i in own._encode_single_piece(p)] and count.tolist() == [len(own._encode_single_piece(p)) for p in pieces]


def test_new_pieces_of_a_batch_cost_no_calls_each(library, monkeypatch):
    """CPU time is that of new pieces: one goes into the table once, whatever signs stand around it, and its tree grows with all others'."""
    words = ["".join(p) for p in itertools.product("abdeilnorst", repeat=4)][:6000]
    texts = [" ".join(words[k::6]) + "".join(f" {w}{sign}" for w in words[k::60] for sign in (",", ".", "###", "!?")) for k in range(6)]
    calls = []
    for name in ("text", "piece", "join"):
        monkeypatch.setattr(bpe.TreeBPE, name, lambda self, *a, f=getattr(bpe.TreeBPE, name): calls.append(1) or f(self, *a))
    code = bpe.DocumentEncoder(PATH, PATTERN)
    ids, per, _ = code(pa.array(texts))
    assert ids.tolist() == [i for t in texts for i in library.encode_ordinary(t)] and per.sum() == len(ids)
    assert code.table.count == len({m for t in texts for m in tree().matches(t)})
    assert len(calls) < 100


@pytest.mark.parametrize("pattern", [r"[^x]+|x", r"\s?\w+[\r\n]*|[^\w]", r"[a-z]+"])
def test_other_patterns(pattern):
    own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.load_ranks(PATH), special_tokens={})
    texts = ["and so on, and so", "", None, "one x two\n\nthree", "\u4e2d x \u00e9t\u00e9"]
    ids, per, digits = bpe.DocumentEncoder(PATH, pattern)(pa.array(texts))
    want = [own.encode_ordinary(t or "") for t in texts]
    assert ids.tolist() == sum(want, []) and per.tolist() == [len(x) for x in want]
    assert digits == [",".join(map(str, x)).encode() for x in want]


def test_table_is_bounded_by_ids_too(library):
    code = bpe.DocumentEncoder(PATH, PATTERN, capacity=16)
    for k in range(6):
        texts = [chr(0x4E00 + k) * 600, "word " * k]
        ids, _, _ = code(pa.array(texts))
        assert ids.tolist() == [i for t in texts for i in library.encode_ordinary(t)]
        assert code.table.count <= 6


def digest(library, i, text):
    ids = library.encode_ordinary(text or "")
    sha = lambda x: hashlib.sha256(x).hexdigest()
    return i, len(ids), sha(",".join(map(str, ids)).encode()), sha((text or "").encode())


def test_documents(spark, library):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert sorted(map(tuple, bpe.encode(docs, PATH, PATTERN).collect())) == sorted(digest(library, r.doc_id, r.text) for r in docs.collect())


def test_odd_rows_and_decoding(spark, library, odd_docs):
    got = bpe.encode(odd_docs, PATH, PATTERN, with_ids=True)
    assert sorted((tuple(r[:4]) for r in got.collect()), key=str) == sorted((digest(library, i, t) for i, t in ODD_TEXTS), key=str)
    back = bpe.decode(got, PATH, PATTERN).collect()
    assert sorted(bytes(r.decoded) for r in back) == sorted((t or "").encode() for _, t in ODD_TEXTS)
    assert bpe.encode(odd_docs.limit(0), PATH, PATTERN).count() == 0


def test_ids_of_any_type(spark):
    docs = spark.createDataFrame([("a", "x y"), (None, None)], "doc_id string, text string")
    assert sorted((r.doc_id or "", r.n_tokens) for r in bpe.encode(docs, PATH, PATTERN).collect()) == [("", 0), ("a", 2)]
