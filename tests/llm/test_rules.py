import math
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa

from cases import ODD_TEXTS, SF
from foliant.llm import queries, rules
from foliant.llm.textbatch import WordTable, text_bytes

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    grams = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
    repeat = {k + j for k in range(len(w) - 2) if grams[tuple(w[k : k + 3])] > 1 for j in range(3)}
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    failed = len(w) < 50 or 100 * len(repeat) > 50 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(repeat), failed


def rows(got):
    return sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got), key=str)


def test_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = queries.op9_rules(spark, SF).collect()
    assert rows(got) == sorted(((r.doc_id, *brute(r.text)) for r in docs), key=str)
    assert not any(r.kept and r.base_failed for r in got)


def test_ratio_drops_junk_and_keeps_prose(spark):
    sf = SF.replace("0.001", "0.01")
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = [r for r in queries.op9_rules(spark, sf).collect() if not r.base_failed and r.doc_id in quality]
    assert np.mean([r.kept == bool(quality[r.doc_id]) for r in got]) > 0.97
    assert all(r.kept for r in got if quality[r.doc_id])


def test_odd_rows(odd_docs):
    trusted = odd_docs.where("doc_id in (1, 5)")
    ratio = rules.ratios(odd_docs, trusted)
    assert rows(rules.report(odd_docs, ratio).collect()) == sorted(((i, *brute(t)) for i, t in ODD_TEXTS), key=str)
    assert not rules.ratios(odd_docs, trusted.limit(0)).any()
    assert rules.report(odd_docs.limit(0), ratio).count() == 0


def test_ratio_is_that_of_counts(spark):
    docs = spark.createDataFrame([(1, "abcdefgh" * 5), (2, "zyxwvuts" * 5)], "doc_id long, text string")
    ratio = rules.ratios(docs, docs.where("doc_id = 1"))
    got = {r.doc_id: r.log_ratio for r in rules.report(docs, ratio).collect()}
    assert got[1] > 0 > got[2]


def morse(n):
    out = "a"
    for _ in range(n):
        out += out.translate(str.maketrans("ab", "ba"))
    return out


def test_equal_hashes_are_told_apart(spark, monkeypatch):
    one = morse(12)
    other = one.translate(str.maketrans("ab", "ba"))
    texts = [f"{one}\n{other}", f"t {one} y u {other} y", f"{one}\n{other}\n{one}", f"p {one} q p {one} q"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    ratio = np.zeros(1 << rules.BITS)
    assert rows(rules.report(docs, ratio).collect()) == sorted(((i, *brute(t)) for i, t in enumerate(texts)), key=str)
    # any hash at all
    monkeypatch.setattr(rules, "mix", lambda x: x * np.uint64(0))
    monkeypatch.setattr(rules, "span_hash", lambda buf, a, b: np.zeros(len(a), np.uint64))
    many = [*texts, *(t or "" for _, t in ODD_TEXTS), "a b c\nx\na b c\nx a b c"]
    buf, offsets = text_bytes(pa.array(many))
    got = rules.base_counts(buf, offsets, WordTable(None))
    assert list(zip(*(got[c].tolist() for c in rules.COUNTED), strict=True)) == [brute(t)[:5] for t in many]


def grams(text):
    """Hashed 4-byte grams by plain arithmetic."""
    raw, out = (text or "").encode(), []
    for k in range(len(raw) - 3):
        h = 4
        for b in raw[k : k + 4]:
            h = (h * 0x01000193 & 0xFFFFFFFF) ^ b
        out.append((h * 0x9E3779B1 & 0xFFFFFFFF) >> (32 - rules.BITS))
    return out


def test_ratio_and_verdict_by_brute_force(spark):
    sf = SF.replace("0.001", "0.01")
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    good = {r.doc_id for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if r.quality == 1}
    raw, target = Counter(), Counter()
    for i, t in docs.items():
        g = grams(t)
        raw.update(g)
        if i in good:
            target.update(g)
    n = 1 << rules.BITS
    base = math.log(sum(raw.values()) + n) - math.log(sum(target.values()) + n)
    ratio = {k: math.log(target[k] + 1) - math.log(raw[k] + 1) + base for k in raw}
    tables = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1")
    for r in rules.report(tables[0], rules.ratios(*tables)).collect():
        g = grams(docs[r.doc_id])
        want = sum(map(ratio.__getitem__, g)) / max(1, len(g))
        assert abs(r.log_ratio - want) < 1e-9
        assert r.kept == (not r.base_failed and want >= rules.THRESHOLD) or abs(want - rules.THRESHOLD) < 1e-9


def test_null_and_repeated_ids_in_the_ratio(spark):
    docs = spark.createDataFrame([(1, "abcdefgh"), (1, "ijklmnop"), (None, "qrstuvwx"), (2, None)], "doc_id long, text string")
    trusted = spark.createDataFrame([(1,), (1,), (None,)], "doc_id long")
    ratio = rules.ratios(docs, trusted)
    up = {t: sum(ratio[g] for g in grams(t)) > 0 for t in ("abcdefgh", "ijklmnop", "qrstuvwx")}
    assert up == {"abcdefgh": True, "ijklmnop": True, "qrstuvwx": False}


def test_query_equals_sql(spark, tmp_path, odd_docs):
    odd_docs.select("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (5, 1, 1), (6, 0, None), (None, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for at, files in ((SF.replace("0.001", "0.01"), ""), (str(tmp_path), "/*.parquet")):
        con = duckdb.connect()
        for t in ("documents", "labels"):
            con.sql(f"create view {t} as select * from '{at}/{t}.parquet{files}'")
        got, want = queries.op9_rules(spark, at), con.sql(queries.OP9_SQL)
        assert got.columns == want.columns
        assert sorted(map(tuple, got.collect()), key=str) == sorted(want.fetchall(), key=str)
