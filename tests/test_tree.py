"""Roll-ups by levels, subtree totals, ranges of folder numbers, and what a catalog makes of them."""

import random

import pytest
from pyspark.sql import functions as F

from foliant.operators import facets, rollup, sets, tree
from foliant.plans.query import parse
from foliant.schema import MAX_DEPTH, RAW
from foliant.sources import catalog

PATHS = ["/", "/a", "/a/b", "/a/b/c", "/a/b/c/d/e", "/a.b", "/a/bc", "/x/y/z", "//q", "///r", "/t/", "/t//u", "plain", "plain/in", "", "/é/ü", "/a b/c"]


def up(path):
    """The folder above as the original roll-up finds it: none for paths without a slash and for the root."""
    k = path.rfind("/")
    return None if k < 0 or path == "/" else "/" if k == 0 else path[:k]


def brute_sizes(local):
    total = dict(local)
    for d in sorted(local, key=len, reverse=True):
        if up(d) in total and up(d) != d:
            total[up(d)] += total[d]
    return total


def under(path, scope):
    return scope == "/" or path == scope or path.startswith(scope + "/")


@pytest.mark.parametrize("seed", range(3))
def test_sizes_and_totals_by_brute_force(spark, seed):
    rng = random.Random(seed)
    paths = rng.sample(PATHS, 12)
    local = {p: rng.randrange(100) for p in paths}
    dirs = spark.createDataFrame(list(local.items()), "dir_path string, local_bytes long").repartition(3)
    assert {r.dir_path: r.total_bytes for r in tree.folder_sizes(dirs).collect()} == brute_sizes(local)
    rows = [(p, k, rng.randrange(9)) for p in paths for k in range(rng.randrange(1, 4))]
    got = tree.subtree_totals(spark.createDataFrame(rows, "dir_path string, k int, n long"), ["k"], {"n": F.sum("n")}).collect()
    scopes = {r.dir_path for r in got}
    assert scopes >= set(paths) and len(got) == len({(r.dir_path, r.k) for r in got})
    for scope in scopes - {""}:  # asked for, that is the root
        want = {}
        for p, k, n in rows:
            if under(p, scope):
                want[k] = want.get(k, 0) + n
        assert {r.k: r.n for r in got if r.dir_path == scope} == want, scope


def test_levels(spark):
    got = {r.p: (r.n, r.a) for r in spark.createDataFrame([(p,) for p in PATHS], "p string").select("p", tree.level(F.col("p")).alias("n"), tree.above(F.col("p")).alias("a")).collect()}
    for p, (n, above) in got.items():
        steps, at = 0, p
        while at != "/":
            at, steps = up(at) or "/", steps + 1
        assert n == steps and above == (up(p) or "/"), p


def test_no_folders(spark):
    none = spark.createDataFrame([], "dir_path string, local_bytes long")
    assert tree.folder_sizes(none).count() == 0
    assert tree.subtree_totals(none, [], {"local_bytes": F.sum("local_bytes")}).count() == 0


def test_a_million_folders_under_one_root(spark):
    """The root's row is summed up in part where its children are: no task meets them all."""
    n = 1_000_000
    dirs = spark.range(n, numPartitions=8).select(F.concat(F.lit("/f"), F.col("id").cast("string")).alias("dir_path"), (F.col("id") % 7).alias("local_bytes"))
    dirs = dirs.unionByName(spark.createDataFrame([("/", 5)], "dir_path string, local_bytes long"))
    got = tree.folder_sizes(dirs)
    assert got.count() == n + 1 and got.where("dir_path = '/'").first().total_bytes == 5 + sum(k % 7 for k in range(n))
    given = dirs.groupBy(tree.parent(F.col("dir_path")).alias("dir_path")).agg(F.sum("local_bytes").alias("given"))
    assert "partial_sum" in given._jdf.queryExecution().executedPlan().toString()


def test_a_subtree_is_a_range(spark):
    dirs = spark.createDataFrame([(p, 1, 0) for p in PATHS], "dir_path string, local_bytes long, first_entry_id long").repartition(4)
    numbered = rollup.numbered(dirs)
    at = {r.dir_path: r.folder for r in numbered.collect()}
    assert sorted(at.values()) == list(range(1, len(PATHS) + 1))
    none = spark.createDataFrame([], "dir_path string, category int, ext string, cnt long")
    ranges, _, _ = rollup.scope_totals(numbered, none, none)
    for r in ranges.where("dir_path != ''").collect():
        assert {p for p in PATHS if under(p, r.dir_path)} == {p for p, k in at.items() if r.first <= k <= r.last}, r.dir_path


def made(spark, n=4000, seed=1, folders=60):
    """Entries whose ids follow no order of folders."""
    rng = random.Random(seed)
    at = [f"/{rng.choice('abc')}/{rng.choice('xyz')}{k % 9}/{k}" for k in range(folders)] + ["/a", "/only"]
    rows = [(rng.randrange(10**9), f"{rng.choice(('report', 'photo', 'été', 'x'))}_{k}.{rng.choice(('pdf', 'txt', 'E' + str(k % 50), 'jpg'))}", rng.choice(at), k % 1000, k, 0, rng.randrange(4)) for k in range(n)]
    rows = list({r[0]: r for r in rows}.values())
    return rows, spark.createDataFrame(rows, RAW).repartition(8)


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    rows, entries = made(spark)
    root = f"file://{tmp_path_factory.mktemp('tree')}"
    held, catalog.FILE_ROWS = catalog.FILE_ROWS, 150
    try:
        catalog.build(entries, root)
    finally:
        catalog.FILE_ROWS = held
    return rows, root, catalog.Catalog(spark, root, index_files=0, ordered_files=0), catalog.Catalog(spark, root)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_facets_of_a_scope_read_one_folder(spark, built):
    _, _, c, _ = built
    for scope in ("/", "/a", "/a/", "/b/x1", "/only", "/nothing", ""):
        assert facets.histogram(c.histogram, scope, totals=c.scope_histogram).collect() == facets.histogram(c.histogram, scope).collect()
        for category, most in ((1, 99), (2, 3), (1, 0), (9, 32))[: 4 if scope == "/a" else 2]:
            got, want = (facets.extension_breakdown(c.ext_breakdown, scope, MAX_DEPTH, category, most, totals=t) for t in (c.scope_exts, None))
            assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
        if scope:
            got, want = (facets.facet_model(c.histogram, c.ext_breakdown, scope, exts=5, totals=t) for t in ((c.scope_histogram, c.scope_exts), None))
            assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert facets.histogram(c.histogram, "/a", 1, totals=c.scope_histogram).collect() == facets.histogram(c.histogram, "/a", 1).collect()
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    for df in (facets.histogram(c.histogram, "/a", totals=c.scope_histogram), facets.extension_breakdown(c.ext_breakdown, "/a", MAX_DEPTH, 1, totals=c.scope_exts)):
        assert "EqualTo(dir_path,/a)" in plan(df) and "StringStartsWith" not in plan(df)


def test_a_subtree_reaches_the_statistics(spark, built):
    rows, _, c, _ = built
    for scope in ("/a", "/b/x1", "/only", "/nothing", "/"):
        got = sets.subtree_entries(c.entries, c.tree, scope)
        assert sorted(r.entry_id for r in got.collect()) == sorted(r[0] for r in rows if under(r[2], scope))
    assert "PushedFilters" in (text := plan(sets.subtree_entries(c.entries, c.tree, "/a"))) and "GreaterThanOrEqual(folder," in text and "LessThanOrEqual(folder," in text


QUERIES = ("report", "ÉTÉ_1", "report_39", "eport", "e", "no such name anywhere", "photo cat:images", "cat:text ext:txt", "report_1 size:>500", "x_3999.", "été")


def test_grams_choose_files_and_lose_no_match(spark, built):
    rows, _, c, plain = built
    assert len(c.files) > 20
    for text in QUERIES:
        for scope in ("/", "/a")[: 2 if text in ("e", "report_39") else 1]:
            want = plain.query(text, scope).collect()
            assert c.query(text, scope).collect() == want
            assert c.query(text, scope, max_results=7).collect() == want[:7]
    assert c.query("no such name anywhere").count() == 0 and c.opened == []
    for name in (r[1] for r in rows[::900]):
        assert c.query(name).count() and 0 < len(c.opened) < len(c.files)


def test_no_match_opens_no_entry_file(spark, built):
    _, _, c, _ = built
    assert "FileScan" not in plan(c.query("zzqqzz"))


def test_a_capped_search_opens_few_files(spark, built):
    rows, root, _, _ = built
    by_id = spark.createDataFrame(sorted(rows), RAW).withColumn("dir_path", F.concat(F.lit("/d"), F.lpad((F.col("entry_id") / 10**6).cast("int").cast("string"), 4, "0"))).withColumn("category", F.lit(0))
    held, catalog.FILE_ROWS = catalog.FILE_ROWS, 100
    try:
        catalog.build(by_id, f"{root}-by-id")
    finally:
        catalog.FILE_ROWS = held
    c, plain = catalog.Catalog(spark, f"{root}-by-id", index_files=0, ordered_files=0), catalog.Catalog(spark, f"{root}-by-id")
    assert len(c.files) >= 30
    for cap in (0, 1, 5, 60, 10**6):
        assert c.query("report", max_results=cap).collect() == plain.query("report", max_results=cap).collect()
        if 0 < cap <= 5:
            assert 0 < len(c.opened) <= 6
    assert len(c.opened) == len(c.candidates(parse("report", 0)))


def test_a_damaged_snapshot_does_not_open(spark, tmp_path):
    root = f"file://{tmp_path}/cat"
    _, entries = made(spark, 300)
    at = tmp_path / "cat" / catalog.build(entries, root).snapshot
    assert catalog.Catalog(spark, root).count() == 300
    for part in ("entries", "grams", "scope_exts", "tree"):
        one = sorted((at / part).rglob("*.parquet"))[0]
        whole = one.read_bytes()
        one.write_bytes(whole[:-1])
        with pytest.raises(catalog.CatalogError, match="manifest"):
            catalog.Catalog(spark, root)
        one.unlink()
        with pytest.raises(catalog.CatalogError, match="None bytes"):
            catalog.Catalog(spark, root)
        one.write_bytes(whole)
        (one.parent / "part-more.parquet").write_bytes(whole)
        with pytest.raises(catalog.CatalogError, match="None by the manifest"):
            catalog.Catalog(spark, root)
        (one.parent / "part-more.parquet").unlink()
    assert catalog.Catalog(spark, root).entries.count() == 300
    for f in (at / "MANIFEST", at / ".MANIFEST.crc"):
        f.unlink(missing_ok=True)
    with pytest.raises(catalog.CatalogError, match="no manifest"):
        catalog.Catalog(spark, root)


def snapshots(tmp_path):
    return {p.name for p in (tmp_path / "cat").iterdir() if p.name.startswith("snapshot-")}


def test_builds_remove_what_no_reader_holds(spark, tmp_path):
    root = f"file://{tmp_path}/cat"
    rows = spark.createDataFrame([(1, "a.txt", "/a", 1, 1, 0, 2)], RAW)
    first = catalog.build(rows, root).snapshot
    reader = catalog.Catalog(spark, root)
    second = catalog.build(rows, root).snapshot
    assert snapshots(tmp_path) == {first, second}
    third = catalog.build(rows, root).snapshot
    assert snapshots(tmp_path) == {first, second, third} and reader.entries.count() == 1  # the one held, and the one replaced
    fourth = catalog.build(rows, root).snapshot
    assert snapshots(tmp_path) == {first, third, fourth}
    assert reader.refresh() and reader.identity.snapshot == fourth
    fifth = catalog.build(rows, root).snapshot
    assert snapshots(tmp_path) == {fourth, fifth}
    sixth, seventh = catalog.build(rows, root).snapshot, catalog.build(rows, root).snapshot
    assert snapshots(tmp_path) == {fourth, sixth, seventh}
    reader.close()
    eighth = catalog.build(rows, root).snapshot
    assert snapshots(tmp_path) == {seventh, eighth}
    with pytest.raises(catalog.CatalogError):
        catalog.build(rows, root, expected=2)
    assert snapshots(tmp_path) == {seventh, eighth}  # nothing of a build that failed
    lost = catalog.Catalog(spark, root)
    catalog.build(rows, root)
    store = catalog.Store(spark, root)
    assert catalog.remove_free(store, {lost.identity.snapshot + "x"}, catalog.time.time() + catalog.LEASE + 60)  # its reader is gone for a day
    assert lost.identity.snapshot not in snapshots(tmp_path)
