import itertools
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from cases import SF
from foliant.llm import features, langid, quality, queries
from foliant.llm.textbatch import SpanHash, text_bytes

SF2 = SF.replace("0.001", "0.01")


def held(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


def test_byte_grams_stay_inside_texts():
    texts = ["abcabc", "", "ab", "abc", None, "xabc"]
    buf, offsets = text_bytes(pa.array(texts, pa.string()))
    h, count = features.byte_grams(buf, offsets, 3, 20)
    assert count.tolist() == [4, 0, 0, 1, 0, 2]
    assert h[0] == h[3] == h[4] == h[6] and h[5] != h[0]
    for few in (["ab"], [None, ""], ["a", "b", "c"]):
        h, count = features.byte_grams(*text_bytes(pa.array(few, pa.string())), 3, 20)
        assert not len(h) and not count.any()


def test_span_hash_tells_strings_apart():
    words = [f"w{k}" for k in range(5000)]
    buf, offsets = text_bytes(pa.array(words + words, pa.string()))
    h = SpanHash()(buf, offsets[:-1], offsets[1:])
    assert len(set(h.tolist())) == 5000 and (h[:5000] == h[5000:]).all()


def test_language_held_out_accuracy(spark):
    want = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF2}/documents.parquet").collect()}
    got = queries.op1_language(spark, SF2).collect()
    assert len(got) == len(want) and all(r.held_out == held(r.doc_id) and 0 <= r.score <= 1 for r in got)
    out = [r for r in got if r.held_out]
    assert np.mean([r.lang_pred == want[r.doc_id] for r in out]) > 0.98
    assert np.mean([r.rejected for r in out]) < 0.1


def test_language_odd_rows(spark, odd_docs):
    model = langid.fit(spark.read.parquet(f"{SF}/documents.parquet"))
    got = langid.predict(odd_docs, model).collect()
    texts = [t for _, t in __import__("cases").ODD_TEXTS]
    assert sum(r.lang_pred == "und" for r in got) == sum(not langid.has_letter(t) for t in texts)
    assert all(r.score == 0 and r.rejected for r in got if r.lang_pred == "und")
    nothing = langid.fit(odd_docs.limit(0))
    assert {r.lang_pred for r in langid.predict(odd_docs, nothing).collect()} == {"und"}
    assert langid.predict(odd_docs.limit(0), model).count() == 0
    foreign = spark.createDataFrame([(1, "жшщ ыъэ юяё " * 30)], "doc_id long, text string")
    assert langid.predict(foreign, model).first().rejected


def test_k_means_is_the_same_each_time():
    x = langid.unit(np.random.default_rng(0).random((60, 20)))
    assert (langid.k_means(x, 3) == langid.k_means(x, 3)).all()


def test_quality_held_out_accuracy(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF2}/labels.parquet").collect()}
    got = queries.op2_quality(spark, SF2).collect()
    assert len(got) == spark.read.parquet(f"{SF2}/documents.parquet").count()
    assert all(r.held_out == held(r.doc_id) and r.predicted == (r.score >= 0.7) for r in got)
    out = [r for r in got if r.held_out and r.doc_id in labels]
    assert np.mean([r.predicted == labels[r.doc_id] for r in out]) > 0.95


def test_quality_odd_rows(spark, odd_docs):
    labels = spark.createDataFrame([(1, 1, 0), (5, 0, 1), (6, 1, None), (7, 0, 0), (9, None, 0), (None, 1, 0), (1, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit(odd_docs, labels)
    got = quality.with_score(odd_docs, model, name="good")
    assert got.columns == [*odd_docs.columns, "good"]
    assert all(0 <= r.good <= 1 for r in got.collect()) and got.count() == odd_docs.count()
    assert quality.good(odd_docs, model).columns == odd_docs.columns
    untaught = quality.fit(odd_docs, labels.limit(0))
    assert quality.good(odd_docs, untaught).count() == odd_docs.count()
    assert quality.good(odd_docs.limit(0), model).count() == 0


def test_samples_are_bounded_whatever_ids_repeat(spark, monkeypatch):
    ids = [None] * 2000 + [7] * 1000 + list(range(10, 510))
    docs = spark.createDataFrame([(i, f"some words and number {k}", "ab"[k % 2]) for k, i in enumerate(ids)], "doc_id long, text string, lang string").repartition(4).cache()
    sizes = []
    monkeypatch.setattr(langid, "k_means", lambda x, k, f=langid.k_means: sizes.append(len(x)) or f(x, k))
    langid.fit(docs, rows=40)
    assert len(sizes) == 2 and all(5 <= n <= 20 for n in sizes)
    labels = spark.createDataFrame([(i, k % 2) for k, i in enumerate([*range(10, 60), *[7] * 300])], "doc_id long, quality int")
    taught = []
    monkeypatch.setattr(quality, "train", lambda rows, f=quality.train: taught.extend(rows) or f(rows))
    quality.fit(docs, labels)
    assert len(taught) == 52  # the id 7 once with each label
    taught.clear()
    quality.fit(docs, labels, rows=20)
    assert 5 <= len(taught) <= 20


def test_every_language_is_learned(spark):
    docs = spark.createDataFrame([(k, f"{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}q{chr(97 + k // 676)} " * 5, f"l{k % 300:03}") for k in range(1200)], "doc_id long, text string, lang string")
    model = langid.fit(docs, rows=100)
    assert len(model.languages) == 300
    with pytest.raises(ValueError):
        langid.fit(docs.selectExpr("doc_id", "text", "concat(lang, doc_id) as lang").unionByName(docs.selectExpr("explode(sequence(1, 5)) as k", "*").selectExpr("doc_id", "text", "concat(k, lang, doc_id) as lang")))


def test_null_and_repeated_ids_are_learned_from(spark):
    rows = [(None, f"the words of english text {k}", "en") for k in range(3000)] + [(7, f"der text auf deutsch steht hier {k}", "de") for k in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs)
    assert model.languages == ["de", "en"]
    assert {(r.doc_id, r.lang_pred) for r in langid.predict(docs, model).collect()} == {(None, "en"), (7, "de")}


def gram(values, bits):
    h = len(values)
    for b in values:
        h = (h * 0x01000193 & 0xFFFFFFFF) ^ b
    return (h * 0x9E3779B1 & 0xFFFFFFFF) >> (32 - bits)


def word_bucket(word, bits):
    """The polynomial word hash by plain arithmetic."""
    mask, root = (1 << 64) - 1, 0x9E3779B97F4A7C15
    x = sum((b + 1) * pow(root, i, 1 << 64) for i, b in enumerate(word.encode())) & mask
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = ((x ^ (x >> shift)) * by) & mask
    return (x ^ (x >> 31)) >> (64 - bits)


TEXTS = ["the quick brown fox fox fox", "", "é è ü ß", "a", "日本語 text 🎉🎉", "One\ntwo\ttwo", None, "x" * 90, "fox", "fox"]


def plain_features(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    out = [word_bucket(x, quality.BITS) for x in w] + [quality.REPEAT for a, b in itertools.pairwise(w) if a == b]
    return out + [gram([ord(c) for c in text[k : k + n]], quality.BITS) for n in quality.GRAMS for k in range(len(text or "") - n + 1)]


def test_quality_features_and_score_by_brute_force():
    rng = np.random.default_rng(5)
    model = quality.Model(rng.normal(0, 3, quality.ROWS), 0.3)
    col = pa.array(TEXTS, pa.string())
    parts = [(h.tolist(), np.cumsum([0, *per]).tolist()) for h, per in quality.features(*text_bytes(col))]
    for k, text in enumerate(TEXTS):
        got = [x for h, at in parts for x in h[at[k] : at[k + 1]]]
        assert sorted(got) == sorted(plain_features(text))
    want = []
    for text in TEXTS:
        f = plain_features(text)
        want.append(1 / (1 + math.exp(-(0.3 + sum(model.weight[x] for x in f) / (len(f) + quality.PRIOR)))))
    assert np.allclose(model.score(col), want)


def test_a_training_step_follows_the_gradient():
    """The table moves along the numerical gradient of the cross entropy."""
    rows = [(np.array([1, 2, 3]), np.array([0.2, 0.5, 0.1]), 1), (np.array([3, 4]), np.array([0.4, 0.4]), 0)]
    rng = np.random.default_rng(1)
    table, layer, bias = rng.normal(size=(6, 3)), rng.normal(size=(3, 2)), rng.normal(size=2)
    for bucket, part, label in rows:
        def loss(t):
            z = part @ t[bucket] @ layer + bias
            return math.log(np.exp(z).sum()) - z[label]

        down = quality.gradient(table, layer, bias, bucket, part, label)
        for k, c in itertools.product(range(len(bucket)), range(3)):
            moved = table.copy()
            moved[bucket[k], c] += 1e-6
            assert abs((loss(moved) - loss(table)) / 1e-6 - np.outer(part, down[2])[k, c]) < 1e-4


def test_language_by_brute_force():
    rng = np.random.default_rng(2)
    n = 1 << langid.BITS
    model = langid.Model(["aa", "bb"], rng.random(n) + 0.5, langid.unit(rng.random((3, n))), np.array([0, 0, 1]), np.array([0.1, 0.9]))
    got = langid.classify(model, pa.array(TEXTS, pa.string()))
    for k, text in enumerate(TEXTS):
        x = np.zeros(n)
        folded = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in (text or "").encode())
        for size in langid.GRAMS:
            for i in range(len(folded) - size + 1):
                x[gram(folded[i : i + size], langid.BITS)] += 1
        x = np.sqrt(x) * model.idf
        cosine = model.centroids @ (x / max(np.linalg.norm(x), 1e-12))
        best = int(np.argmax(cosine))
        letters = any(c.isalpha() for c in text or "")
        assert got["lang_pred"][k] == (model.languages[model.of[best]] if letters else "und")
        assert abs(got["score"][k] - (cosine[best] if letters else 0)) < 1e-5
        assert got["rejected"][k] == (not letters or 1 - cosine[best] > model.radius[model.of[best]])


def test_a_language_of_repeated_texts_is_learned(spark):
    others = [(k, f"the words of text number {k} and more of them", "en") for k in range(300)]
    for many in ([(None, "der die das und nicht", "de")] * 20_000, [(7, f"der die das und nicht {k % 5}", "de") for k in range(20_000)]):
        docs = spark.createDataFrame(many + others, "doc_id long, text string, lang string").repartition(4)
        assert langid.fit(docs).languages == ["de", "en"]
