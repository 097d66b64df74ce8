import hashlib
import os
import pickle
import re
import time

import duckdb
import pyarrow as pa
from hypothesis import example, given, settings
from hypothesis import strategies as st

from cases import SF
from foliant.llm import decontam, queries

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, window):
    out = []
    for i, text in docs:
        w, hit, found = words(text), set(), set()
        for item, body in items:
            v = words(body)
            n = min(window, len(v))
            grams = {tuple(v[k : k + n]) for k in range(len(v) - n + 1)} if v else set()
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in grams:
                    hit.update(range(k, k + n))
                    found.add(str(item))
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return out


@settings(max_examples=500, deadline=None)
@example(["b", "aaba"], "aaba", 4)
@example(["b", "aaba", "ab", "abaab"], "aabaabaab", 4)
@given(st.lists(st.text("abc", max_size=9), max_size=6), st.text("abcd", max_size=40), st.integers(1, 4))
def test_automaton_finds_every_occurrence(items, doc, window):
    shard = decontam.make_shard([(str(k), [c.encode() for c in x]) for k, x in enumerate(items)], window)
    if not shard:
        return
    index = {w: k for k, w in enumerate(shard.vocabulary)}
    hit, found = set(), set()
    run = []
    for k, c in enumerate([*doc.encode(), None]):
        w = None if c is None else index.get(bytes([c]))
        if w is None:
            spans, got = shard.automaton.stream(run)
            hit |= {k - len(run) + x for a, b in spans for x in range(a, b)}
            found |= got
            run = []
        else:
            run.append(w)
    want = brute([(0, " ".join(doc))], [(k, " ".join(x)) for k, x in enumerate(items)], window)[0]
    assert (len(hit), len(found)) == (want[2], want[3])


ITEMS = [(1, "One two three four five six seven eight nine ten eleven twelve thirteen fourteen."), (2, "short item"), (3, None), (4, ""), (5, "Été à Paris"), (2, "short item again"), (None, "lost")]
DOCS = [(1, "x one TWO three, four five six seven eight nine ten eleven twelve thirteen y"), (2, None), (3, ""), (4, "A short\nitem; short item again! " + "pad " * 200), (5, "Été à paris " * 2), (None, "short item"), (1, "nothing"), (6, "!!! ...")]


def frames(spark):
    return spark.createDataFrame([(*d, 1, "z") for d in DOCS], "doc_id long, text string, n_words int, item string"), spark.createDataFrame([(*i, "c") for i in ITEMS], "item_id long, text string, doc_id string")


def test_odd_rows_in_one_and_many_shards(spark):
    docs, items = frames(spark)
    want = sorted(brute(DOCS, [i for i in ITEMS if i[0] is not None], 13), key=str)
    assert sorted(map(tuple, decontam.report(docs, items).collect()), key=str) == want
    for pass_shards in (1, 2, 8):
        assert sorted(map(tuple, decontam.report(docs, items, shard_bytes=20, pass_shards=pass_shards).collect()), key=str) == want
    assert decontam.report(docs.limit(0), items).count() == 0
    assert {r.n_hit for r in decontam.report(docs, items.limit(0)).collect()} == {0}


def test_items_with_a_null_id_are_hit(spark, tmp_path):
    docs, items = [*DOCS[:5], (7, "all is lost"), (8, "Lost: a short item")], [*ITEMS, (None, "all is"), (None, "lost")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    got = sorted(map(tuple, queries.op5_decontaminate(spark, str(tmp_path)).collect()))
    assert got == sorted(con.sql(queries.OP5_SQL).fetchall())
    counts = lambda rows: [(*r[:4], r[5]) for r in rows]
    assert counts(got) == counts(sorted(brute(docs, items, 13)))
    frames = spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/benchmark.parquet")
    assert sorted(map(tuple, decontam.report(*frames, shard_bytes=8).collect())) == got
    assert not {7, 8} & {r.doc_id for r in decontam.decontaminate(*frames).collect()}


def test_one_word_over_and_over_is_linear():
    began = time.perf_counter()
    shard = decontam.make_shard([("a", [b"x"] * 40_000)], 13)
    found, items = shard.automaton.stream([0] * 40_000)
    assert time.perf_counter() - began < 4
    assert found == [(0, 40_000)] and items == {"a"}


def test_long_items_in_chunks_and_bounded_shards(spark):
    import random

    rng = random.Random(1)
    text = " ".join(rng.choice("abcdefg") * rng.randint(1, 3) for _ in range(5000))
    items = spark.createDataFrame([(1, text), (2, "short one"), (1, text), (3, " ".join(text.split()[:13]))], "item_id long, text string")
    got = list(decontam.shards(items, shard_bytes=6000))
    assert len(got) > 2 and all(len(s.automaton.link) < 2 * 4000 for s in got)
    w = text.split()
    docs = [(k, "zz " + " ".join(w[k : k + n]) + " zz zz") for k, n in ((0, 13), (980, 30), (985, 13), (988, 13), (1, 12), (4987, 13), (4986, 14), (0, 5000))]
    want = sorted(brute(docs, [(r.item_id, r.text) for r in items.collect()], 13))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    for size, pass_shards in ((6000, 1), (6000, 8), (1 << 20, 8)):
        assert sorted(map(tuple, decontam.report(frame, items, shard_bytes=size, pass_shards=pass_shards).collect())) == want


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text("abc", max_size=9), max_size=6), st.lists(st.text("abcd.", max_size=30), max_size=4), st.integers(1, 4), st.integers(1, 3))
def test_scan_of_packs_finds_every_occurrence(items, docs, window, size):
    made = [decontam.make_shard([(str(k), [c.encode() for c in x])], window) for k, x in enumerate(items)]
    docs = [" ".join(d) for d in docs]
    batch, found = pa.RecordBatch.from_pydict({"text": pa.array(docs, pa.string())}), None
    for pack in decontam.packs(filter(None, made), size):
        pack = pickle.loads(pickle.dumps(pack))
        new = decontam.scan(batch, "text", pack, decontam.table_of(pack.vocabulary))
        found = new if found is None else decontam.merge([{k: found[k][d] for k in found} for d in range(len(docs))], new)
    if found and docs:
        want = brute(enumerate(docs), [(k, " ".join(x)) for k, x in enumerate(items)], window)
        assert [(len(a), len(b)) for a, b in zip(found["hit_words"], found["hit_items"], strict=True)] == [(w[2], w[3]) for w in want]


def test_ten_megabytes_of_items_in_two_passes(spark, tmp_path, monkeypatch):
    # 60,000 items of words like w17, each 25 words or some more; documents quote some of them
    word = "concat('w', pmod(xxhash64(id, k), 5000))"
    items = spark.range(60_000).selectExpr("id as item_id", f"array_join(transform(sequence(1, 25 + cast(id % 7 as int)), k -> {word}), ' ') as text")
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    items = spark.read.parquet(f"{tmp_path}/benchmark.parquet")
    quoted = items.where("item_id % 97 = 0").selectExpr("item_id as doc_id", "concat(repeat('pad w1 ', cast(item_id % 50 as int)), substring_index(text, ' ', 12 + cast(item_id % 3 as int)), ' zz ', text) as text")
    fresh = spark.range(1_000_000, 1_001_000).selectExpr("id as doc_id", f"array_join(transform(sequence(1, 200), k -> {word}), ' ') as text")
    quoted.union(fresh).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    writes, write = [], decontam.written
    monkeypatch.setattr(decontam, "written", lambda df, stem: writes.append(stem) or write(df, stem))
    got = sorted(map(tuple, decontam.report(docs, items).collect()))
    assert len(writes) == 1  # between two passes
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    assert con.sql("select sum(strlen(text)) from benchmark").fetchall()[0][0] > 9_000_000
    assert got == sorted(con.sql(queries.OP5_SQL).fetchall())
    assert sum(r[5] for r in got) > 600


def test_no_folder_stays_but_the_last(spark):
    from foliant.llm import session

    docs, items = frames(spark)
    at = session.shared_dir(spark).removeprefix("file:")
    before = set(os.listdir(at))
    with session.Run(spark) as mine:
        left = decontam.decontaminate(docs, items, shard_bytes=8, pass_shards=1)
        assert left.count() and len(set(os.listdir(at)) - before) == 1
        mine.drop()
    assert set(os.listdir(at)) == before


def test_names_of_columns_are_free(spark):
    docs, items = frames(spark)
    docs = docs.selectExpr("*", "'own' as hits", "array(1) as `__hits`")
    found = decontam.find_hits(docs, items, shard_bytes=20)
    assert found.columns == [*docs.columns, "hits_"] and {r.hits for r in found.collect()} == {"own"}


def test_drop_and_cut(spark):
    docs, items = frames(spark)
    left = decontam.decontaminate(docs, items)
    assert left.columns == docs.columns
    assert sorted(str(r.text)[:7] for r in left.collect()) == ["", "!!! ...", "A short", "None", "nothing"]
    cut = {r.doc_id: r.text for r in decontam.decontaminate(docs.where("doc_id in (1, 5)"), items, action="cut").collect() if r.text != "nothing"}
    assert cut == {1: "x  y", 5: " "}
    assert decontam.decontaminate(docs.where("doc_id = 4"), items, action="cut_all").first().text.startswith("A ! pad")


def test_query_equals_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = queries.op5_decontaminate(spark, SF)
    want = con.sql(queries.OP5_SQL)
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())
