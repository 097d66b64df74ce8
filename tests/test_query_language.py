import pytest
from hypothesis import given
from hypothesis import strategies as st

from foliant.plans import query as q
from foliant.plans.query import Category, Date, Extension, Kind, Path, Query, Size, StructuredFilter, parse

NOW = 1_700_000_000
MB = 1 << 20


@pytest.mark.parametrize(("text", "want"), [
    ("hello world", Query("hello world")),
    ("  hello   world ", Query("hello world")),
    ("tab\tstays one", Query("tab\tstays one")),
    ("kind:folder", Query("", (Kind(1),))),
    ("KIND:Dir kind:directory kind:link !kind:file", Query("", (Kind(1), Kind(1), Kind(2), Kind(0, True)))),
    ("report ext:pdf size:>1mb", Query("report", (Extension("pdf"), Size("gt", MB)))),
    ("!ext:lock !kind:symlink", Query("", (Extension("lock", True), Kind(2, True)))),
    ("cat:images date:week", Query("", (Category(1), Date("gte", NOW - 7 * 86400)))),
    ("size:1mb..10mb", Query("", (Size("range", MB, 10 * MB),))),
    ("size:>=1kb size:<=2k size:<3b size:4", Query("", (Size("gte", 1024), Size("lte", 2048), Size("lt", 3), Size("eq", 4)))),
    ("path:src/ !path:Tmp", Query("", (Path("src/"), Path("Tmp", True)))),
    ("", Query()),
    ("foo:bar hello", Query("foo:bar hello")),
    ("foo ext:pdf bar", Query("foo bar", (Extension("pdf"),))),
    ("ext:SVG,webp", Query("", (Extension("svg,webp"),))),
    ("ext:, ext:" + "a" * 65 + " kind:x cat:y kind: :file !", Query("ext:, ext:" + "a" * 65 + " kind:x cat:y kind: :file !")),
    ("ext:PÅ ext:Ƃ", Query("", (Extension("på"), Extension("ƃ")))),
    ("!size:>1mb !date:today", Query("", (Size("gt", MB), Date("gte", 1_699_913_600)))),
    ("!!ext:x", Query("!!ext:x")),
    ("size:> size:>= size:>x size:1..", Query("size:> size:>= size:>x size:1..")),
    ("path:" + "p" * 255 + " path:" + "p" * 256, Query("path:" + "p" * 256, (Path("p" * 255),))),
    ("date:2024-01-01", Query("", (Date("range", 1_704_067_200, 1_704_153_600),))),
    ("date:2024-01-01..2024-12-31", Query("", (Date("range", 1_704_067_200, 1_735_689_600),))),
    ("date:>2024-01-01 date:<2024-01-01", Query("", (Date("gt", 1_704_067_200), Date("lt", 1_704_067_200)))),
    ("date:>=2024-01-01 date:>bad date:notadate", Query("date:>=2024-01-01 date:>bad date:notadate")),
    ("size:9kb..3kb", Query("", (Size("range", 9216, 3072),))),
])
def test_parse(text, want):
    assert parse(text, NOW) == want


@pytest.mark.parametrize(("text", "want"), [("100", 100), ("100b", 100), ("1kb", 1024), ("1K", 1024), ("1mb", MB), ("1m", MB), ("1gb", 1 << 30), ("2T", 2 << 40), ("500kb", 512_000), ("1.5mb", 1_572_864), ("0.3kb", 307), ("", None), ("abc", None), ("1xx", None), ("1.2.3", None), (".", None), ("99999999999999999tb", None), ("1e400mb", None), ("99999999999999999.0tb", None), ("18446744073709551615", (1 << 64) - 1), ("18446744073709551616", None), ("9" * 5000, None), ("0" * 5000 + "7kb", 7168), ("9" * 5000 + ".5", None)])
def test_sizes(text, want):
    assert q.parse_size(text) == want


@pytest.mark.parametrize(("text", "ok"), [("2024-02-29", True), ("2024-12-31", True), ("0001-01-01", True), ("2024-02-31", False), ("2024-04-31", False), ("2023-02-29", False), ("2024-13-01", False), ("2024-00-10", False), ("0000-01-01", False), ("+024-01-01", False), ("2024-1-1", False)])
def test_dates(text, ok):
    assert (q.parse_date(text) is not None) == ok
    if ok and text > "1970":
        assert q.date_text(q.parse_date(text)) == text


@pytest.mark.parametrize("text", ["ext:svg,webp", "!ext:tar.zst,iso", "kind:folder", "!kind:symlink", "cat:code", "!cat:other", "size:>1mb", "size:1mb..10mb", "size:>500kb", "size:<=0", "size:7b", "date:>2024-01-01", "date:today", "date:week", "date:month", "date:year", "date:2024-01-01..2024-02-01", "path:Src/"])
def test_printing_is_the_inverse(text):
    (c,) = parse(text, NOW).criteria
    assert q.format_criterion(c, NOW) == text
    assert parse(q.format_criterion(c, NOW), NOW).criteria == (c,)


def test_printing_odd_values():
    assert q.date_text(0) == q.date_text(-5) == "1970-01-01"
    assert q.size_text(1_600_000) == "1.5mb" and q.size_text(1500) == "1.5kb" and q.size_text(3 << 40) == "3072gb"
    assert q.format_criterion(Date("gte", NOW - 86_400 * 100), NOW) == "date:2023-08-06"


def test_structured_filter():
    f = StructuredFilter
    assert f.parse("Cat:AUDIO").category == "audio"
    assert f("audio", frozenset({"ogg", "flac"}), "live").encoded == "cat:audio ext:flac ext:ogg live"
    assert f.parse("tour ext:SVG,webp").encoded == "ext:svg,webp tour"
    assert f.parse("!ext:log,tmp minutes").text == "!ext:log,tmp minutes"
    assert f.parse("cat: ext: a") == f(text="a") and f.parse("cat:a cat:b").category == "b"
    assert f.parse("  ").is_empty


@given(st.one_of(st.none(), st.sampled_from(q.CATEGORY_KEYS)), st.frozensets(st.text("abcxyz.", min_size=1, max_size=5), max_size=4), st.lists(st.text("abcDEF:!", min_size=1, max_size=6).filter(lambda t: not t.lower().startswith(("cat:", "ext:"))), max_size=4))
def test_structured_filter_round_trip(category, extensions, words):
    f = StructuredFilter(category, extensions, " ".join(words))
    assert StructuredFilter.parse(f.encoded) == f


def test_facet_clicks():
    f = StructuredFilter
    assert f("code", frozenset({"a"})).click_extension("b", "text", False) == f("text", frozenset({"b"}))
    assert f("code", frozenset({"a"})).click_extension("a", "code", False) == f("code")
    assert f("code", frozenset({"a", "b"})).click_extension("a", "code", False) == f("code", frozenset({"a"}))
    assert f("code", frozenset({"a"})).click_extension("b", "code", True) == f("code", frozenset({"a", "b"}))
    assert f("code", frozenset({"a"})).click_extension("b", "text", True) == f(None, frozenset({"a", "b"}))
    assert f("code", frozenset({"a", "b"})).click_extension("a", "code", True) == f("code", frozenset({"b"}))
    assert f().click_extension("a", "code", True) == f("code", frozenset({"a"}))
    assert f(extensions=frozenset({"svg,webp"})).shows("webp") and not f(extensions=frozenset({"xwebp"})).shows("webp")


def test_saved_filters_and_paths():
    assert q.saved_already("EXT:pdf  cat:code x", ["a", "cat:CODE x ext:pdf"]) and not q.saved_already("", [""])
    for text, want in (("~", "/h"), ("~/x/../y", "/h/y"), ("/a//b/", "/a/b"), ("c", "/base/c"), (" ../d ", "/d")):
        assert q.resolve_path(text, "/base", "/h") == want
    assert q.scope_of("folder", "/a", 9) == ("/a", 1) and q.scope_of("subfolders", "/a", 9) == ("/a", 9) and q.scope_of("everywhere", "/a", 9) == ("/", 9)
    assert q.promoted("folder", "x") == "subfolders" and q.promoted("folder", "") == "folder" and q.promoted("everywhere", "x") == "everywhere"
