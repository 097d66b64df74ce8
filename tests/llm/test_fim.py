import hashlib

import regex
from hypothesis import given
from hypothesis import strategies as st

from cases import ODD_TEXTS, SF
from foliant.llm import fim


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute(doc_id, text):
    """The contract written out over a list of characters."""
    units = list(text or "")
    digest = sha(f"1:{'' if doc_id is None else doc_id}")
    h1, h2, h3, h4 = (int(digest[k : k + 8], 16) for k in (0, 8, 16, 24))
    n = len(units)
    whole = "".join(units)
    if not units or "<P>" in whole or "<S>" in whole or "<M>" in whole or h3 % 100 >= 90:
        return doc_id, n, "plain", None, None, sha(whole), sha(whole)
    a, b = min(h1 % (n + 1), h2 % (n + 1)), max(h1 % (n + 1), h2 % (n + 1))
    p, m, s = ("".join(units[i:j]) for i, j in ((0, a), (a, b), (b, n)))
    form, out = ("spm", "<S>" + s + "<P>" + p + "<M>" + m) if h4 % 100 < 20 else ("psm", "<P>" + p + "<S>" + s + "<M>" + m)
    return doc_id, n, form, a, b - a, sha(out), sha(whole)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = [brute(r.doc_id, r.text) for r in docs.collect()]
    assert rows(fim.report(docs)) == sorted(want, key=str)
    assert {r[2] for r in want} == {"plain", "psm", "spm"}


def test_odd_rows(spark, odd_docs):
    assert rows(fim.report(odd_docs)) == sorted((brute(*r) for r in ODD_TEXTS), key=str)
    assert fim.report(odd_docs.limit(0)).count() == 0
    marked = [(k, t) for k, t in enumerate(["a<P>b", "<S>", "x<M>", "<P", "<<S", "P><S", "S>M>", "🎉é" * 50, "\r\n\0 "])]
    assert rows(fim.report(spark.createDataFrame(marked, "doc_id int, text string"))) == sorted((brute(*r) for r in marked), key=str)
    kept = fim.fill_in_middle(odd_docs, name="spans")
    assert sorted(kept.columns) == sorted(odd_docs.columns) and kept.count() == len(ODD_TEXTS)
    assert all(fim.restore(r.spans.output, r.spans.form) == (r.text or "") for r in kept.collect())


def test_very_long_text(spark):
    text = "abé\U0001f389 " * 400_000
    docs = spark.createDataFrame([(3, text), (4, "b"), (5, None)], "doc_id long, text string")
    assert rows(fim.report(docs)) == sorted((brute(r.doc_id, r.text) for r in docs.collect()), key=str)


@given(st.text(alphabet="<>PSM ab\né", max_size=30), st.integers(0, 400))
def test_restored_exactly_whatever_the_units(text, row_id):
    for unit in (fim.CODE_POINT, r"\X", r"\w+|\W+", r"a+"):
        n, form, before, middle, out = fim.rearrange(text, row_id, fim.Plan(rate=100, unit=unit), regex.compile(unit))
        assert fim.restore(out, form) == text
        assert form == "plain" or before + middle <= len(text)
        assert n == sum(1 for _ in regex.finditer(unit, text))
