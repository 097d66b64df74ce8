import tracemalloc

import public_tokenizers
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer, models, normalizers

from cases import ODD_TEXTS, SF
from foliant.llm import queries, unigram

PATH = public_tokenizers.path("piece_bpe_32k.model")


def library(vocabulary, fallback=True):
    t = Tokenizer(models.Unigram(vocabulary, 0, fallback))
    t.normalizer = normalizers.Sequence([normalizers.Prepend(unigram.BLANK), normalizers.Replace(" ", unigram.BLANK)])
    return lambda text: len(t.encode(text or "", add_special_tokens=False).ids)


HELD = {}


def held():
    if not HELD:
        vocabulary = unigram.load_vocabulary(PATH)
        HELD["own"], HELD["library"] = unigram.UnigramCounter(vocabulary), library(vocabulary)
    return HELD["own"], HELD["library"]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=80), st.text("aeinrst \n", max_size=80)), max_size=6))
def test_counts_equal_the_library(texts):
    own, lib = held()
    assert own.parts
    assert own.batch(pa.array(texts, pa.string())).tolist() == [lib(t) for t in texts]


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.text("abc▁", min_size=1, max_size=3), st.integers(-4, 0), min_size=1, max_size=12), st.text("abcd ", max_size=14))
def test_ties_in_small_vocabularies(pieces, text):
    vocabulary = [("<unk>", 0.0), *((p, float(s)) for p, s in pieces.items())]
    own = unigram.UnigramCounter(vocabulary)
    assert own.batch(pa.array([text])).tolist() == [library(vocabulary, False)(text)]


def test_memory_does_not_grow_with_a_text():
    own, lib = held()
    text = "wide\t \x0b words▁and  Ünïcode " * 12_000
    prepared = unigram.BLANK + text.replace(" ", unigram.BLANK)
    tracemalloc.start()
    got = own.count_prepared(prepared)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got == lib(text)
    assert peak < 8 * len(text)  # the text itself, as the automaton holds it; lists for each character took over 100


def test_documents(spark):
    _, lib = held()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = queries.op8_token_counts(spark, SF).collect()
    assert sorted((r.doc_id, r.n_tokens) for r in got) == sorted((i, lib(t)) for i, t in docs.items())


def test_odd_rows(odd_docs):
    _, lib = held()
    got = unigram.count_tokens(odd_docs, PATH)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(((i, lib(t)) for i, t in ODD_TEXTS), key=str)
    assert unigram.count_tokens(odd_docs.limit(0), PATH).count() == 0
