import pytest
from pyspark.sql import functions as F

from foliant.functions import fold, humanize, names
from foliant.operators import sets
from foliant.schema import CATEGORY_OF
from foliant.sources import demo


def column(spark, values, make, kind="string"):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, v {kind}")
    return [r.out for r in df.select("k", make(F.col("v")).alias("out")).orderBy("k").collect()]


def test_fold_table():
    pairs = fold.pairs()
    assert len(pairs) == 1474
    assert all(len(a.encode()) == len(b.encode()) and a != b for a, b in pairs.items())
    assert all(fold.fold(b) == b for b in pairs.values())  # folding twice is folding once


def test_fold(spark):
    cases = {"ΟΔΟΣ": "οδοσ", "οδος": "οδοσ", "CŒUR": "cœur", "ŁÓDŹ": "łódź", "µ": "μ", "×": "×", "ẞ": "ẞ", "K": "K", "ſ": "ſ", "İ": "İ", "Crème Brûlée.DOCX": "crème brûlée.docx", "Москва": "москва", "Ƃudget": "ƃudget", "ᲐᲜ": "ან", "": ""}
    assert [fold.fold(t) for t in cases] == list(cases.values())
    assert column(spark, list(cases), fold.folded) == list(cases.values())
    assert column(spark, ["KÖLN Süd"], fold.lower_ascii) == ["kÖln süd"]
    assert fold.fold_bytes(b"A\xff\xc3B\x80\xe2\x82") == b"a\xff\xc3b\x80\xe2\x82"


def test_categories_and_extensions(spark):
    want = {"photo.png": 1, "photo.JPG": 1, "readme.md": 2, "report.pdf": 3, "data.csv": 4, "song.mp3": 5, "movie.mp4": 6, "main.zig": 7, "program.sema": 7, "backup.tar": 8, "backup.tar.gz": 8, "Makefile": 0, "": 0, ".gitignore": 0, ".env": 0, "sums.toml.old": 0, "x.makefile": 7}
    assert column(spark, list(want), names.categorize) == list(want.values())
    exts = {"foo.tar.gz": "gz", ".gitignore": None, "noext": None, "": None, "trailing.": None, "a\nb.Txt": "Txt", "..x": "x"}
    assert column(spark, list(exts), names.extension) == list(exts.values())
    bucket = {".env": "env", "Foo.APP": "app", "x.": None, "x." + "e" * 16: None, "x." + "e" * 15: "e" * 15, "plain": None}
    assert column(spark, list(bucket), names.bucket_extension) == list(bucket.values())
    assert column(spark, ["a.B", ".x", "y.", "z"], lambda c: names.extension_text(c, F.lit(0))) == ["b", "—", "—", "—"]
    assert column(spark, ["a.B"], lambda c: names.extension_text(c, F.lit(1))) == ["—"]
    assert column(spark, ["a.MD", "b.markdown", "c.sema", "d.json", "e.txt"], lambda c: names.preview_format(c, F.lit(0))) == ["markdown", "markdown", "sema", "json", None]
    assert column(spark, [0, 3, 9, -1], names.category_name, "int") == ["Other", "Documents", "Other", "Other"]


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_ascii_has_a_short_way_to_the_same_fold(spark):
    every = [chr(k) for k in (*range(1, 0xD800), *range(0xE000, 0x20000))]
    texts = ["".join(every[k : k + 64]) for k in range(0, len(every), 64)] + ["A", "ÀA", "AZ[a\x7f", "", None]
    assert column(spark, texts, fold.folded) == [t and fold.fold(t) for t in texts]
    assert column(spark, texts, fold.lower_ascii) == [t and fold.fold_ascii(t) for t in texts]
    for make in (fold.folded, fold.lower_ascii):
        assert "lower(" in plan_of(spark.createDataFrame([("A",)], "v string").select(make(F.col("v"))))


def test_categories_of_rows(spark):
    files = {f"x.{e}": c for ext, c in CATEGORY_OF.items() for e in (ext, ext.upper())} | {"x.m\u212av": 0, "x.\n": 0, "x.pdf\n": 0, "a.b/c": 0, "..pdf": 3, ".pdf": 0, "pdf": 0, "x.": 0, "x.pdf.": 0, "": 0}
    rows = spark.createDataFrame([(n, 0) for n in files] + [("x.pdf", 1), (None, 0)], "name string, kind int")
    got = names.with_category(rows)
    assert got.columns == ["name", "kind", "category"] and dict(got.dtypes)["category"] == "int"
    assert {(r.name, r.kind): r.category for r in got.collect()} == {(n, 0): c for n, c in files.items()} | {("x.pdf", 1): 0, (None, 0): 0}
    plan = plan_of(got)
    assert "element_at" not in plan and plan.count("translate(") == 1  # the key is made once, no map is searched


def test_the_first_word_of_a_text_makes_no_list_of_words():
    assert "split_part(coalesce(text" in demo.FILES_SQL and "split_part(coalesce(text" not in demo._spark_sql(demo.FILES_SQL)


def test_escapes(spark):
    texts = ["plain", "we\tird\nna\\me", "\\t", "\\\\n", "end\\", "\\x", "", "a\\\tb"]
    escaped = column(spark, texts, names.escape_tsv)
    assert not any("\t" in e or "\n" in e for e in escaped)
    assert column(spark, escaped, names.unescape_tsv) == texts
    assert column(spark, [r"\x\q", "a\\", r"\\\t"], names.unescape_tsv) == [r"\x\q", "a\\", "\\\t"]


def test_paths(spark):
    rows = spark.createDataFrame([("/home/user/docs", "report.pdf"), ("/home/user/src", "app.zig"), ("/home/user", "src"), ("/", "top"), ("/home/username", "n")], "dir_path string, name string")
    shown = lambda scope, full=False: [r[0] for r in rows.select(names.display_name(F.col("dir_path"), F.col("name"), scope, full)).collect()]
    assert shown("/home/user") == ["docs/report.pdf", "src/app.zig", "src", "//top", "/home/username/n"]
    assert shown("/home/user/docs/")[0] == "report.pdf"
    assert shown("/")[2:4] == ["home/user/src", "top"]
    assert shown("/x", True)[1::2] == ["/home/user/src/app.zig", "//top"]
    assert column(spark, ["/a/b", "/a", "/", "x", "a/b"], names.parent) == ["/a", "/", "/", None, "a"]
    assert column(spark, ["/a/out", "/a/out/i", "/a/out-x", "/a/ou"], lambda c: names.is_under(c, "/a/out")) == [True, True, False, False]
    assert [names.strip_slash(p) for p in ("/a/", "/", "/a", "/a//")] == ["/a", "/", "/a", "/a/"]


def test_numbers(spark):
    got = lambda make, values, kind="bigint": column(spark, values, make, kind)
    assert got(humanize.binary_bytes, [0, 512, 1023, 1024, 48_000_000, 1 << 40, (1 << 50) * 3]) == ["0 B", "512 B", "1023 B", "1.0 KiB", "45.7 MiB", "1.0 TiB", "3.0 PiB"]
    assert got(humanize.duration, [-4, 620, 31_480, 4199, 127_000, 3_600_000]) == ["0ms", "620ms", "31.4s", "4.1s", "2m 07s", "60m 00s"]
    assert got(humanize.count, [999, 8_213_409]) == ["999", "8,213,409"]
    assert got(humanize.spaced_count, [8_213_409]) == ["8 213 409"]
    sizes = [0, 999, 1000, 1049, 1050, 1150, 248_850, 612_150, 999_949, 999_951, 123_456_789, 5_000_000_000, 7_250_000_000_000, 9_000_000_000_000_000]

    def plain(n):
        value, unit = float(n), 0
        while value >= 1000 and unit < 4:
            value, unit = value / 1000, unit + 1
        return f"{n} B" if not unit else "%.1f %s" % (value, ("B", "KB", "MB", "GB", "TB")[unit])

    assert got(humanize.decimal_bytes, sizes) == [plain(n) for n in sizes]
    day, now = 86_400, 1_700_000_000
    assert got(lambda c: humanize.age(c, now), [now + 5, now - day + 1, now - day, now - 29 * day, now - 30 * day, now - 364 * day, now - 365 * day]) == ["today", "today", "1d ago", "29d ago", "1mo ago", "12mo ago", "1y ago"]
    assert got(lambda c: humanize.freshness(c, now), [now, now - 60, now - 3600, now - day, now - 31 * day, now - 800 * day]) == ["just now", "1m", "1h", "1d", "1mo", "2y"]
    assert got(humanize.utc_date, [-5, 0, 1_704_067_200]) == ["1970-01-01", "1970-01-01", "2024-01-01"]
    assert got(humanize.iso_date, [1_704_067_200]) == ["2024-01-01"]
    assert got(lambda c: humanize.result_count(c, 2000), [5, 2000]) == ["5", "2000+"]


def test_previews(spark):
    values = [b"hello", b"caf\xc3\xa9", b"bad\xff!", b"123456789"]
    got = column(spark, values, lambda c: names.preview_text(c, 8), "binary")
    assert got == ["hello", "café", "bad�!", "12345678\n\n— Preview truncated at 8 bytes —\n"]
    assert column(spark, values, lambda c: names.preview_highlighted(c, 8, 5), "binary") == [True, True, True, False]


def test_terminals(spark):
    assert column(spark, ["kitty"], sets.terminals) == [["kitty", "iTerm", "Ghostty", "WezTerm", "Alacritty", "Terminal"]]


@pytest.mark.parametrize(("values", "want"), [([3, 1, 2], (2, 1, 3)), ([4, 1, 2, 3], (3, 1, 4)), ([5], (5, 5, 5))])
def test_sample_statistics(spark, values, want):
    df = spark.createDataFrame([("a", v) for v in values], "k string, v int")
    assert tuple(sets.sample_statistics(df, "k", "v").first())[1:] == want
