import json
import os
import threading
import time

import pytest
from pyspark.sql import functions as F

from foliant import queries
from foliant.functions.fold import fold, folded
from foliant.operators import facets, rollup, search, sets
from foliant.operators.search import CancelToken, Cancelled, QuerySession, QueryTooLong
from foliant.schema import MAX_DEPTH, RAW, RESULT
from foliant.sources import catalog, files, shards
from foliant.sources.userstate import UserState
from foliant.streaming import watch

#: (name, dir_path, size, mtime, kind, category); the entry's id is its place.
GOLDEN = [
    ("report.pdf", "/home/user/docs", 2_097_152, 1_700_000_000, 0, 3),
    ("photo.jpg", "/home/user/pics", 512_000, 1_700_100_000, 0, 1),
    ("notes.txt", "/home/user/docs", 1024, 1_700_200_000, 0, 2),
    ("src", "/home/user", 0, 1_700_300_000, 1, 0),
    ("report_v2.pdf", "/home/user/docs", 5_242_880, 1_700_400_000, 0, 3),
    ("app.zig", "/home/user/src", 8192, 1_700_500_000, 0, 7),
]


def frame(spark, rows):
    return spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], RAW)


def stored(spark, rows):
    return frame(spark, rows).withColumn("name_folded", folded(F.col("name")))


@pytest.fixture(scope="module")
def golden(spark, tmp_path_factory):
    root = f"file://{tmp_path_factory.mktemp('golden')}"
    catalog.build(frame(spark, GOLDEN), root, expected=6, created=5)
    return catalog.Catalog(spark, root)


def names_of(df):
    return [r.name for r in df.collect()]


@pytest.mark.parametrize(("query", "scope", "depth", "want"), [
    ("report", "/", MAX_DEPTH, ["report.pdf", "report_v2.pdf"]),
    ("ext:pdf", "/", MAX_DEPTH, ["report.pdf", "report_v2.pdf"]),
    ("kind:folder", "/", MAX_DEPTH, ["src"]),
    ("!kind:directory", "/", MAX_DEPTH, ["report.pdf", "photo.jpg", "notes.txt", "report_v2.pdf", "app.zig"]),
    ("size:>5000", "/", MAX_DEPTH, ["report.pdf", "photo.jpg", "src", "report_v2.pdf", "app.zig"]),
    ("size:>1mb", "/", MAX_DEPTH, ["report.pdf", "report_v2.pdf"]),
    ("cat:documents", "/", MAX_DEPTH, ["report.pdf", "report_v2.pdf"]),
    ("report size:>3mb", "/", MAX_DEPTH, ["report_v2.pdf"]),
    ("ext:pdf size:>3mb", "/", MAX_DEPTH, ["report_v2.pdf"]),
    ("nonexistent", "/", MAX_DEPTH, []),
    ("", "/", MAX_DEPTH, []),
    ("cat:code", "/", MAX_DEPTH, ["app.zig"]),
    ("cat:code report", "/", MAX_DEPTH, []),
    ("", "/home/user", 1, ["src"]),
    ("", "/home/user/docs", 1, ["report.pdf", "notes.txt", "report_v2.pdf"]),
    ("", "/home/user", MAX_DEPTH, [r[0] for r in GOLDEN]),
    ("", "/home/user/", 999, [r[0] for r in GOLDEN]),
    ("app", "/home/user/docs", MAX_DEPTH, []),
    ("report", "/home/user/docs", MAX_DEPTH, ["report.pdf", "report_v2.pdf"]),
    ("ext:pdf", "/home/user/docs", 1, ["report.pdf", "report_v2.pdf"]),
    ("", "/nonexistent/deep/path", MAX_DEPTH, []),
    ("", "/", 1, []),
    ("", "/", 2, [r[0] for r in GOLDEN]),
    ("size:99999999999gb", "/", MAX_DEPTH, []),
    ("!size:<18446744073709551615", "/home/user/docs", 1, ["report.pdf", "notes.txt", "report_v2.pdf"]),
])
def test_golden_queries(golden, query, scope, depth, want):
    assert names_of(golden.query(query, scope, depth)) == want


def test_cap_and_limits(golden):
    assert names_of(golden.query("report", max_results=1)) == ["report.pdf"]
    assert names_of(golden.query("report", max_results=0)) == []
    with pytest.raises(QueryTooLong):
        golden.query("x" * 257)
    golden.query("é" * 128)


def test_golden_facets(golden):
    counts = lambda *a: {r.category: r.cnt for r in facets.histogram(golden.histogram, *a).collect()}
    assert counts("/home/user/docs", 1) == {**dict.fromkeys(range(9), 0), 2: 1, 3: 2}
    assert counts("/home/user") == {**dict.fromkeys(range(9), 0), 0: 1, 1: 1, 2: 1, 3: 2, 7: 1}
    assert not any(counts("/no/such/folder", 1).values()) and not any(counts("/home/user/").values())
    exts = lambda *a: [(r.ext, r.cnt) for r in facets.extension_breakdown(golden.ext_breakdown, *a).collect()]
    assert exts("/home/user/docs", 1, 3) == [("pdf", 2)] and exts("/", 999, 3, 1) == [("pdf", 2)] and exts("/", 999, 7) == [("zig", 1)]
    assert exts("/no", 1, 3) == exts("/", 999, 5) == exts("/", 999, 0) == exts("/", 999, 9) == exts("/", 999, 3, 0) == []
    model = facets.facet_model(golden.histogram, golden.ext_breakdown, "/home/user").orderBy("rank").collect()
    assert [(r.category, r.cnt, r.extensions) for r in model] == [(3, 2, "pdf:2"), (1, 1, "jpg:1"), (2, 1, "txt:1"), (7, 1, "zig:1")]


def test_predicates_reach_the_scan(spark, golden):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = golden.query("report cat:documents", "/home/user")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "category" in plan.split("PartitionFilters")[1][:120]
    assert "StringContains(name_folded,report)" in plan and "StringStartsWith(dir_path,/home/user/)" in plan


def test_scope_stops_at_slashes(spark):
    rows = stored(spark, [("x.txt", "/a/b", 1, 1, 0, 2), ("y.txt", "/a/bc", 1, 1, 0, 2), ("z.txt", "/a/b/c", 1, 1, 0, 2)])
    assert names_of(search.search(rows, "", "/a/b")) == names_of(search.search(rows, "", "/a/b/")) == ["x.txt", "z.txt"]


def test_extension_lists(spark):
    rows = stored(spark, [(n, "/d", 1, 1, 0, 0) for n in ("logo.svg", "hero.webp", "LOUD.SVG", "notes.css", "map.min.svg", "min.svg", ".svg", "x.asvg", "svg")])
    assert names_of(search.search(rows, "ext:svg,webp")) == ["logo.svg", "hero.webp", "LOUD.SVG", "map.min.svg", "min.svg", ".svg"]
    assert names_of(search.search(rows, "ext:min.svg")) == ["map.min.svg"]
    assert names_of(search.search(rows, "ext:css ext:webp !ext:svg")) == ["hero.webp", "notes.css"]


def test_unicode_names_and_the_old_fold(spark):
    rows = stored(spark, [(n, "/d", 1, 1, 0, 0) for n in ("Crème Brûlée.DOCX", "KÖLN Süd.csv", "ΘΑΛΑΣΣΑ.log", "Волга.png", "Ƃriefing.md", "ᲗᲑᲘᲚᲘᲡᲘ.ini")])
    for q in ("brûlée", "BRÛLÉE", "Brûlée", "köln", "KÖLN", "θαλασσα", "ΘΑΛΑΣΣΑ", "волга", "ВОЛГА", "ƃriefing", "თბილისი"):
        assert search.search(rows, q).count() == 1, q
    old = frame(spark, [("KÖLN.csv", "/d", 1, 1, 0, 0)]).withColumn("name_folded", F.lit("kÖln.csv"))
    assert search.search(old, "KÖLN", version=6).count() == 1 and search.search(old, "köln", version=6).count() == 0


def test_sorts(spark):
    rows = stored(spark, [("Beta.txt", "/d", 300, 200, 0, 2), ("alpha.txt", "/d", 100, 300, 0, 1), ("gamma.txt", "/d", 200, 100, 0, 3)])
    by = lambda c, **k: [n.split(".")[0] for n in names_of(search.sort_results(rows, c, **k))]
    assert by("name") == ["alpha", "Beta", "gamma"] and by("size") == ["alpha", "gamma", "Beta"] and by("mtime") == ["gamma", "Beta", "alpha"] and by("category") == ["gamma", "alpha", "Beta"]
    ties = stored(spark, [("f.txt", "/z", 1, 1, 0, 0), ("f.txt", "/a", 1, 1, 0, 0), ("b", "/a", 1, 1, 0, 0)])
    assert [(r.name, r.dir_path) for r in search.sort_results(ties, "size", False).collect()] == [("b", "/a"), ("f.txt", "/a"), ("f.txt", "/z")]
    mixed = stored(spark, [("zeta.txt", "/", 1, 1, 0, 0), ("alpha", "/", 1, 1, 1, 0), ("beta.txt", "/", 1, 1, 0, 0), ("omega", "/", 1, 1, 1, 0)])
    assert names_of(search.sort_results(mixed, "name", True, True)) == ["alpha", "omega", "beta.txt", "zeta.txt"]
    assert names_of(search.sort_results(mixed, "name", False, True))[:2] == ["omega", "alpha"]
    screen = stored(spark, [("big.bin", "/", 100, 1, 0, 0), ("small-folder", "/", 5, 1, 1, 0), ("tiny.txt", "/", 1, 1, 0, 0), ("big-folder", "/", 10, 1, 1, 0)])
    assert names_of(search.screen_sort(screen, "size", False, True)) == ["big-folder", "small-folder", "big.bin", "tiny.txt"]
    assert names_of(search.screen_sort(screen, "name"))[:2] == ["big-folder", "small-folder"]
    assert names_of(search.search_sorted(screen, "", "size", False, max_results=2, max_depth=2)) == ["big.bin", "small-folder"]


def sizes(spark, rows):
    entries = frame(spark, rows)
    return {r.name: r.size for r in rollup.with_folder_sizes(entries, rollup.folder_sizes(rollup.directories(entries))).collect()}


def test_folder_sizes(spark):
    got = sizes(spark, [("a.txt", "/home/u/docs", 100, 1, 0, 2), ("b.txt", "/home/u/docs", 20, 1, 0, 2), ("c.txt", "/home/u/docs/sub", 3, 1, 0, 2), ("sub", "/home/u/docs", 0, 1, 1, 0), ("docs", "/home/u", 0, 1, 1, 0), ("top.txt", "/home/u", 4000, 1, 0, 2)])
    assert (got["sub"], got["docs"], got["top.txt"]) == (3, 123, 4000)
    assert sizes(spark, [("empty", "/home/u", 999, 1, 1, 0), ("f.txt", "/home/u", 7, 1, 0, 2)])["empty"] == 0
    got = sizes(spark, [("x.txt", "/a/b", 1, 1, 0, 2), ("y.txt", "/a/bc", 10, 1, 0, 2), ("b", "/a", 0, 1, 1, 0), ("bc", "/a", 0, 1, 1, 0)])
    assert (got["b"], got["bc"]) == (1, 10)
    gap = rollup.folder_sizes(rollup.directories(frame(spark, [("f", "/a/b/c", 5, 1, 0, 0), ("g", "/a", 1, 1, 2, 0), ("r", "/", 2, 1, 0, 0), ("n", "plain", 3, 1, 0, 0)])))
    assert {r.dir_path: r.total_bytes for r in gap.collect()} == {"/a": 1, "/a/b/c": 5, "/": 3, "plain": 3}


def test_breakdown_keeps_32_and_first_ties(spark):
    rows = [(f"f.e{k:02}", "/d", 1, 1, 0, 0) for k in reversed(range(40))] + [("g.e00", "/d", 1, 1, 0, 0), (".env", "/d", 1, 1, 0, 0), ("Foo.app", "/d", 1, 1, 1, 0)]
    got = rollup.extension_breakdown(frame(spark, rows)).orderBy("rn").collect()
    assert [(r.ext, r.cnt) for r in got[:3]] == [("e00", 2), ("e39", 1), ("e38", 1)] and len(got) == 32
    merged = rollup.extension_breakdown(frame(spark, [("a.pdf", "/home/u/x", 1, 1, 0, 3), ("b.PDF", "/home/u/y", 1, 1, 0, 3)]))
    assert [(r.ext, r.cnt) for r in facets.extension_breakdown(merged, "/home/u", MAX_DEPTH, 3).collect()] == [("pdf", 2)]


def test_breakdown_folds_spellings_and_not_names(spark):
    exts = ("PDF", "pdf", "Pdf", "É", "é", "x" * 16, "", "txt")
    rows = frame(spark, [(f"f{k}.{exts[k * 5 % 8]}" if k % 9 else f"plain{k}", "/d", 1, 1, 0, 3) for k in range(200)])
    got = rollup.extension_breakdown(rows)
    counts = {}
    for r in rows.collect():
        ext = fold(r.name.rpartition(".")[2]) if "." in r.name else ""
        if ext and len(ext.encode()) <= 15:
            counts.setdefault(ext, []).append(r.entry_id)
    want = sorted(((len(ids), min(ids), ext) for ext, ids in counts.items()), key=lambda x: (-x[0], x[1]))
    assert [tuple(r) for r in got.select("cnt", "first_entry_id", "ext", "rn").orderBy("rn").collect()] == [(*w, k) for k, w in enumerate(want, 1)]
    # what lies below the first aggregate works on names: no folding there
    lines = got._jdf.queryExecution().optimizedPlan().toString().split("\n")
    first = max(k for k, line in enumerate(lines) if "Aggregate [" in line)
    assert not any("translate" in line for line in lines[first + 1 :])


def test_floor_lookup_and_lengths(spark):
    rows = frame(spark, [("report", "/d", 1, 1, 0, 0), ("notes", "/d", 1, 1, 0, 0), ("é", "/e", 1, 1, 0, 0)])
    at = spark.createDataFrame([("/d", p) for p in (0, 5, 6, 10, 11)] + [("/e", 1), ("/e", 2)], "dir_path string, pos long")
    got = {(r.dir_path, r.pos): r.entry_id for r in sets.floor_lookup(at, sets.name_offsets(rows)).collect()}
    assert got == {("/d", 0): 0, ("/d", 5): 0, ("/d", 6): 1, ("/d", 10): 1, ("/e", 1): 2}
    assert {r.entry_id: r.length for r in sets.lengths_from_offsets(sets.name_offsets(rows)).collect()} == {0: 6, 1: None, 2: None}


def test_snapshots(spark, tmp_path):
    root = f"file://{tmp_path}/cat"
    with pytest.raises(catalog.CatalogError):
        catalog.Catalog(spark, root)
    first = catalog.build(frame(spark, GOLDEN[:3]), root)
    old = catalog.Catalog(spark, root)
    assert old.count() == 3 and not old.refresh()
    with pytest.raises(catalog.CatalogError):
        catalog.build(frame(spark, GOLDEN), root, expected=7)
    assert not old.refresh()
    second = catalog.build(frame(spark, GOLDEN), root)
    assert first.snapshot != second.snapshot and old.entries.count() == 3  # a reader keeps its own
    assert old.refresh() and old.count() == old.entries.count() == 6
    meta = tmp_path / "cat" / second.snapshot / "META"
    meta.write_text(json.dumps(json.loads(meta.read_text()) | {"schema_version": 5}))
    for crc in meta.parent.glob(".META*crc"):
        crc.unlink()
    with pytest.raises(catalog.CatalogError):
        catalog.Catalog(spark, root)
    assert catalog.build(frame(spark, GOLDEN[:0]), root).entry_count == 0
    assert catalog.Catalog(spark, root).query("x").count() == 0


def test_grams_are_those_of_each_file(spark, tmp_path, monkeypatch):
    plans, grams = [], catalog._grams

    def seen(*args):
        plans.append((found := grams(*args))._jdf.queryExecution().optimizedPlan().toString())
        return found

    monkeypatch.setattr(catalog, "_grams", seen)
    rows = [(n, "/d", 1, 1, 0, k % 3) for k, n in enumerate(("alpha.txt", "ab", "Ünïcode🎉x", "abc", "aaaaaaa", "KÖLN", "", "report.pdf", "x🎉y🎉"))]
    catalog.build(frame(spark, rows), f"file://{tmp_path}/cat")
    made = catalog.Catalog(spark, f"file://{tmp_path}/cat")
    want = {(k, g) for k, f in enumerate(made.files) for r in made.read([f]).collect() for g in catalog.gram_hashes(r.name_folded)}
    assert len({f.path.split("/")[-1] for f in made.files}) < len(made.files)  # one task's files have one name
    got = [(r.file, r.gram) for r in made.grams.collect()]
    assert set(got) == want and len(got) == len(want)
    assert len(plans) == 1 and "lambdafunction" not in plans[0]


def test_a_tree_that_changes_while_it_is_built(spark, tmp_path, monkeypatch):
    tree = tmp_path / "tree"
    for k in range(30):
        (tree / f"d{k % 5}").mkdir(parents=True, exist_ok=True)
        (tree / f"d{k % 5}" / f"f{k}.txt").write_text("x" * 5000)

    def meanwhile(make):
        def run(*args):
            for k in range(7):  # at every step of the build
                (tree / f"late{len(os.listdir(tree))}").write_text("y")
            return make(*args)
        return run

    for step in ("directories", "folder_sizes", "with_folder_sizes", "histogram", "extension_breakdown"):
        monkeypatch.setattr(rollup, step, meanwhile(getattr(rollup, step)))
    scan = files.scan(spark, str(tree)).withColumn("entry_id", F.xxhash64("dir_path", "name"))
    made = catalog.build(scan, f"file://{tmp_path}/cat")
    c = catalog.Catalog(spark, f"file://{tmp_path}/cat")
    assert made.entry_count == c.entries.count() == 35 and len(os.listdir(tree)) == 40
    assert c.histogram.agg(F.sum("cnt")).first()[0] == 35
    of = {r.dir_path: r.local_bytes for r in c.dirs.collect()}
    assert of == {r.dir_path: r.s for r in c.entries.groupBy("dir_path").agg(F.sum(F.when(F.col("kind") != 1, F.col("size")).otherwise(0)).alias("s")).collect()}
    assert not (tmp_path / "cat" / made.snapshot / "scanned").exists()


def test_a_deep_tree_is_split(spark, tmp_path):
    for k in range(40):
        at = tmp_path / "only" / f"a{k % 4}" / f"b{k % 8}"
        at.mkdir(parents=True, exist_ok=True)
        (at / f"f{k}").write_text("x")
    spark.dataSource.register(files.FileTreeSource)
    read = lambda n: spark.read.format("filetree").option("root", str(tmp_path)).option("splits", n).load()
    assert read(1).rdd.getNumPartitions() == 1 and read(4).rdd.getNumPartitions() >= 5
    rows = {n: sorted(map(tuple, read(n).select("name", "dir_path", "kind").collect())) for n in (1, 2, 4, 100)}
    assert len(rows[1]) == 40 + 13 and all(r == rows[1] for r in rows.values())


def test_ranks_over_ranges(spark):
    rows = spark.range(3000).select((F.col("id") * 7919 % 3000).alias("k"), (F.col("id") % 5).alias("g")).repartition(7)
    got = search.rank_rows(rows, [F.desc("g"), F.asc("k")]).collect()
    want = sorted(((r.k, r.g) for r in rows.collect()), key=lambda r: (-r[1], r[0]))
    assert [(r.k, r.g) for r in sorted(got, key=lambda r: r.rank)] == want and sorted(r.rank for r in got) == list(range(1, 3001))
    assert search.rank_rows(rows.limit(0), [F.asc("k")]).count() == 0


def test_ranks_compare_columns_not_expressions(spark, tmp_path, monkeypatch):
    rows = [(n, f"/d{k % 3}", k % 7, k, int(k % 10 == 0), k % 9) for k, n in enumerate(("B.txt", "a.txt", "É", "é", "b.TXT", "Ab") * 40)]
    catalog.build(frame(spark, rows), f"file://{tmp_path}/cat")
    made, plans, written = catalog.Catalog(spark, f"file://{tmp_path}/cat"), [], search.written

    def seen(df, stem):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return written(df, stem)

    monkeypatch.setattr(search, "written", seen)
    for column, ascending, folders in (("category", False, True), ("name", True, False), ("size", False, True)):
        got = queries._REGISTRY[f"srt1_{column}_{'asc' if ascending else 'desc_folders'}"][0](made)
        want = made.entries.select("entry_id", *RESULT).orderBy(*search.sort_keys(column, ascending, folders), "entry_id").collect()
        assert [(k, *r) for k, r in enumerate(want, 1)] == [tuple(r) for r in got.orderBy("rank").collect()]
    sorts = [line for plan in plans for line in plan.splitlines() if "Sort [" in line or "rangepartitioning" in line]
    assert len(sorts) == 6 and not any(f in line for line in sorts for f in ("translate", "lower", "CASE", "element_at"))


def test_blocks_of_a_big_folder(spark, monkeypatch):
    monkeypatch.setattr(sets, "ID_BLOCK", 8)
    rows = [("n" * (1 + k % 4), "/d", 1, 1, 0, k // 6 % 3) for k in range(100)]
    entries = frame(spark, rows)
    offsets = {r.entry_id: r.start for r in sets.name_offsets(entries).collect()}
    sofar = 0
    for k, r in enumerate(rows):
        assert offsets[k] == sofar
        sofar += len(r[0])
    kept = sorted(r.entry_id for r in sets.suppress_repeats(entries.select("dir_path", "entry_id", "category")).collect())
    assert kept == [k for k in range(100) if k == 0 or rows[k][5] != rows[k - 1][5]]


def write(tmp_path, name, text):
    path = tmp_path / name
    path.write_text(text)
    return f"file://{path}"


def test_shards(spark, tmp_path):
    a = write(tmp_path, "a", "a.txt\t/x\t10\t100\t0\t1\n\nb.txt\t/y\t20\t-200\t0\t1\n")
    b = write(tmp_path, "b", "c\t/z\t1\t1\t2\t0")
    assert sorted(map(tuple, shards.read_shards(spark, [a, b]).collect())) == [("a.txt", "/x", 10, 100, 0, 1), ("b.txt", "/y", 20, -200, 0, 1), ("c", "/z", 1, 1, 2, 0)]
    for k, text in enumerate(("missing\tfields", "a\t/x\tnot-a-size\t1\t0\t1", "a\t/x\t1\t1\t0\t1\textra", "a\t/x\t-1\t1\t0\t1")):
        with pytest.raises(Exception, match="malformed"):
            shards.read_shards(spark, write(tmp_path, f"bad{k}", text)).collect()
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        shards.read_shards(spark, [a, f"file://{tmp_path}/missing"]).collect()
    odd = frame(spark, [("we\tird\nna\\me", "/pa\\th", 1, 2, 0, 3)])
    shards.write_shards(odd, f"file://{tmp_path}/out")
    assert tuple(shards.read_shards(spark, f"file://{tmp_path}/out").first()) == ("we\tird\nna\\me", "/pa\\th", 1, 2, 0, 3)


def test_file_scan(spark, tmp_path):
    for path in ("src/main.zig", "src/deep/er/a.md", ".git/config", "node_modules/x.js", "Library/Caches/c.bin", "XLibrary/Caches/k.bin", "Library/Other/o.txt", "top.PDF", "src/.env"):
        at = tmp_path / path
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text("x" * 5000)
    os.symlink("main.zig", tmp_path / "src" / "link.zig")
    got = {f"{r.dir_path}/{r.name}".removeprefix(f"{tmp_path}/"): r for r in files.scan(spark, str(tmp_path)).collect()}
    assert set(got) == {"src", "src/main.zig", "src/deep", "src/deep/er", "src/deep/er/a.md", "src/link.zig", "Library", "Library/Other", "Library/Other/o.txt", "XLibrary", "XLibrary/Caches", "XLibrary/Caches/k.bin", "top.PDF"}
    assert got["src/link.zig"].kind == 2 and got["src"].kind == 1 and got["src"].category == 0 and got["top.PDF"].category == 3 and got["src/main.zig"].category == 7
    assert got["top.PDF"].size == os.stat(tmp_path / "top.PDF").st_blocks * 512 and got["top.PDF"].mtime == int(os.stat(tmp_path / "top.PDF").st_mtime)
    assert files.skips("x", "/" + "d" * 5000, True) and not files.skips("x", "/" + "d" * 5000, False)


def test_exclusions_as_a_filter(spark):
    rows = frame(spark, [("a", "/u", 1, 1, 0, 0), ("Caches", "/u/Library", 1, 1, 1, 0), ("c", "/u/Library/Caches/x", 1, 1, 0, 0), ("k", "/u/XLibrary/Caches", 1, 1, 0, 0), (".x", "/u", 1, 1, 0, 0), ("j", "/u/node_modules/p", 1, 1, 0, 0), ("node_modules", "/u", 1, 1, 0, 0), ("s", "/u/Library/Application Support", 1, 1, 0, 0)])
    assert names_of(files.without_excluded(rows)) == ["a", "k", "s"]


def test_user_state(spark, tmp_path):
    state = UserState(str(tmp_path), "/h")
    assert [p.path for p in state.pins] == ["/h", "/h/Desktop", "/h/Documents", "/h/Downloads"] and not state.folders_on_top
    state.add_pin("P", "/p")
    state.add_pin("P again", "/p")
    state.set_color("/p", (255, 0, 0, 255))
    state.add_filter("f", "cat:code")
    state.add_filter("g", "x")
    state.update_filter(1, "g2", "y")
    state.update_filter(9, "no", "no")
    state.remove_filter(0)
    state.set_folders_on_top(True)
    again = UserState(str(tmp_path), "/h")
    assert [p.name for p in again.pins] == ["Home", "Desktop", "Documents", "Downloads", "P"] and again.is_pinned("/p")
    assert again.colors == {"/p": (255, 0, 0, 255)} and [vars(f) for f in again.filters] == [{"name": "g2", "query": "y"}] and again.folders_on_top
    assert again.color_frame(spark).collect() == [("/p", "#ff0000ff")]
    again.remove_pin("/p")
    again.set_color("/p", None)
    (tmp_path / "pins.json").write_text("{nonsense")
    (tmp_path / "filters.json").write_text('{"a": 1}')
    broken = UserState(str(tmp_path), "/h")
    assert len(broken.pins) == 4 and broken.filters == [] and broken.colors == {}
    assert (tmp_path / "pins.json.corrupt").read_text() == "{nonsense" and (tmp_path / "filters.json.corrupt").exists()


def test_cancellation(spark, golden):
    token = CancelToken()
    assert len(token.run(golden.query("report"))) == 2
    token.cancel()
    with pytest.raises(Cancelled):
        token.run(golden.query(""))
    running = CancelToken()
    threading.Timer(1.5, running.cancel).start()
    slow = spark.range(1, 4, 1, 3).select(F.expr("aggregate(sequence(1, 60000000), 0L, (a, x) -> a + x % 7)"))
    began = time.time()
    with pytest.raises(Cancelled):
        running.run(slow)
    assert time.time() - began < 60


def test_newest_query_wins(spark, golden):
    session = QuerySession()
    assert session.run(lambda: golden.query("report")) and len(session.rows) == 2
    assert [r.name for r in session.resort(spark, "size", False)] == ["report_v2.pdf", "report.pdf"]

    def overtaken():
        session.run(lambda: golden.query("ext:zig"))
        return golden.query("report")

    assert not session.run(overtaken) and [r.name for r in session.rows] == ["app.zig"]


def test_rebuild_rules():
    assert not watch.should_rebuild(0, 1e6, 100) and watch.should_rebuild(1, 30, 100) and not watch.should_rebuild(999, 29, 100)
    assert watch.should_rebuild(1000, 0, 0) and watch.should_rebuild(0, 0, 86_400)
    done = []
    trigger = watch.RebuildTrigger(lambda: done.append(1), 0.0)
    assert not trigger.step(5, 10.0) and trigger.step(0, 30.0) and not trigger.step(0, 100.0) and trigger.step(1000, 101.0)
    assert trigger.step(0, 86_400.0) and trigger.full == 86_400.0 and len(done) == 3

    def fails():
        raise OSError

    broken = watch.RebuildTrigger(fails, 0.0)
    assert not broken.step(5, 40.0) and broken.dirty == 0 and broken.last == 0.0 and not broken.step(0, 80.0) and broken.failures == 1


def polled(events, started, end):
    """What a loop that looks every two seconds does."""
    fired, now, k = [], started, 0
    trigger = watch.RebuildTrigger(lambda: None, float(started))
    events = sorted(events)
    while now <= end:
        now += 2
        n = 0
        while k < len(events) and events[k] < now:
            n, k = n + 1, k + 1
        dirty = trigger.dirty + n
        if trigger.step(n, float(now)):
            fired.append((now, dirty))
    return fired


def test_replay_equals_polling(spark):
    import random

    rng = random.Random(4)
    started = 1_000_000
    events = {"a": [started + rng.randrange(0, 4000) for _ in range(60)], "b": [started + 500 + k // 400 for k in range(3000)], "c": [started + 90_000, started + 100_000]}
    df = spark.createDataFrame([(r, t) for r, ts in events.items() for t in ts], "root string, second long")
    got = watch.replay(watch.ticks(df, "root", F.col("second")), started).collect()
    for root, ts in events.items():
        last = max(ts) // 2 * 2 + 2
        want = [f for f in polled(ts, started, last) if f[0] <= last]
        assert sorted((r.rebuilt_at, r.dirty) for r in got if r.root == root) == want, root


def test_stream_of_changes_rebuilds(spark, tmp_path):
    (tmp_path / "in").mkdir()
    changes = spark.readStream.schema("path string").json(f"file://{tmp_path}/in")
    root, built = f"file://{tmp_path}/cat", []
    trigger = watch.RebuildTrigger(lambda: built.append(catalog.build(frame(spark, GOLDEN), root)), 0.0)
    now = [31.0]
    for k, paths in enumerate((["/u/a", "/u/out/index"], ["/u/out/index"])):
        (tmp_path / "in" / f"{k}.json").write_text("\n".join(json.dumps({"path": p}) for p in paths))
        q = watch.watch(changes, "path", trigger, "/u/out", f"file://{tmp_path}/check", lambda: now[0], available_now=True)
        q.awaitTermination(60)
        now[0] += 40
    assert len(built) == 1 and catalog.Catalog(spark, root).count() == 6


def test_changes_of_a_tree_drive_the_watch(spark, tmp_path):
    tree, log = tmp_path / "tree", f"file://{tmp_path}/log"
    tree.mkdir()
    for n in ("same", "touched", "gone"):
        (tree / n).write_text("x")
        os.utime(tree / n, (1000, 1000))
    scan = lambda: files.scan(spark, str(tree)).withColumn("entry_id", F.xxhash64("dir_path", "name"))
    root = f"file://{tmp_path}/cat"
    catalog.build(scan(), root)
    before = catalog.Catalog(spark, root)
    (tree / "gone").unlink()
    os.utime(tree / "touched", (2000, 2000))
    (tree / "fresh").write_text("y")
    assert sorted((r.path.rsplit("/", 1)[1], r.change) for r in watch.changes(before.entries, scan()).collect()) == [("fresh", "added"), ("gone", "removed"), ("touched", "modified")]
    order = []
    trigger = watch.RebuildTrigger(lambda: order.append("rebuild"), 0.0)
    watch.record(before.entries, scan(), log)
    started = watch.watch_and_build(lambda: order.append("first build"), watch.recorded(spark, log), "path", trigger, None, f"file://{tmp_path}/ck", clock=lambda: 100.0, available_now=True)
    started.awaitTermination(60)
    assert trigger.rebuilds == 1 and sorted(order) == ["first build", "rebuild"]
    with pytest.raises(ZeroDivisionError):
        watch.watch_and_build(lambda: 1 / 0, watch.recorded(spark, log), "path", trigger, None, f"file://{tmp_path}/ck2")
    assert not spark.streams.active


def test_polling_finds_a_newer_snapshot(spark, tmp_path):
    root, now = f"file://{tmp_path}/cat", [0.0]
    catalog.build(frame(spark, GOLDEN[:1]), root)
    c = catalog.Catalog(spark, root, poll=5.0, clock=lambda: now[0])
    catalog.build(frame(spark, GOLDEN), root)
    now[0] = 4.0
    assert c.query("report").count() == 1
    now[0] = 5.0
    assert c.query("report").count() == 2
