"""Registered queries over the derived catalog, each with SQL that DuckDB runs over the same tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import humanize as h
from .functions import names
from .functions.fold import ASCII_LOWER, ASCII_UPPER, folded, tables
from .operators import facets, rollup, sets
from .operators.search import engine_order, list_folder, matching, rank_rows, screen_sort_keys, search
from .plans.query import StructuredFilter, format_criterion, parse
from .schema import CATEGORY_LABELS, CATEGORY_NAMES, DIRECTORY, MAX_DEPTH, RAW, RESULT
from .sources import demo, files, shards
from .sources.catalog import Catalog, Store, build
from .streaming import watch

FOLD, LOWER = demo.FOLD, demo.LOWER
ROW = ", ".join(RESULT)
NOW = demo.NOW

#: name: (function of a catalog, SQL over the CTEs of demo.BASE_SQL or none)
Entry = tuple[Callable[[Catalog], DataFrame], str | None]
_REGISTRY: dict[str, Entry] = {}
#: Searches that look up grams and read files in order of ids whatever their number: query, scope, cap.
_BY_FILES: dict[str, tuple[str, str, int]] = {}


def _quoted(text: str) -> str:
    return text.replace("'", "''")


def _where(text: str, scope: str = "/", depth: int = MAX_DEPTH, extra: str = "true") -> str:
    scope = _quoted(scope)
    under = "true" if scope == "/" and depth != 1 else f"dir_path = '{scope}'" if depth == 1 else f"(dir_path = '{scope}' OR starts_with(dir_path, '{scope}/'))"
    phrase = f"contains(name_folded, {FOLD.format(f"'{_quoted(text)}'")})" if text else "true"
    return f"{phrase} AND {under} AND {extra}"


def add_search(name: str, query: str, text: str, extra: str = "true", scope: str = "/", depth: int = MAX_DEPTH, cap: int = 100_000) -> None:
    """A search and the plain SQL of what it means, spelt out apart from the parser."""
    _REGISTRY[name] = (
        lambda c: search(c.entries, query, scope, depth, cap, NOW).select("entry_id", *RESULT),
        f"SELECT entry_id, {ROW} FROM entries WHERE {_where(text, scope, depth, extra)} ORDER BY entry_id LIMIT {cap}",
    )


def add(name: str, make: Callable[[Catalog], DataFrame], sql: str | None = None) -> None:
    _REGISTRY[name] = (make, sql)


# --- predicates -------------------------------------------------------------------------------------------------
add_search("flt1_text", "ORDER_12", "order_12")
add_search("flt1_text_unicode", "ÉRÉ", "éré")
add_search("flt1_phrase_around_qualifier", "order_1 ext:pdf 2", "order_1 2", "ends_with(name_folded, '.pdf')")
for _name, _query, _text, _extra in (("flt1_text_by_grams", "ORDER_12", "order_12", "true"), ("flt1_unicode_by_grams", "ÉRÉ", "éré", "true"), ("flt1_no_match_by_grams", "zzq no such name", "zzq no such name", "true"), ("flt1_category_by_grams", "order_1 cat:archives", "order_1", "category = 8")):
    add_search(_name, _query, _text, _extra)
    _BY_FILES[_name] = (_query, "/", 100_000)
add_search("flt2_kind_folder", "kind:folder", "", "kind = 1")
add_search("flt2_kind_negated", "!kind:directory !kind:link", "", "kind = 0")
add_search("flt3_ext", "ext:été", "", "ends_with(name_folded, '.été')")
add_search("flt3_ext_list", "ext:PHP,zip", "", "(ends_with(name_folded, '.php') OR ends_with(name_folded, '.zip'))")
add_search("flt3_ext_many_parts", "ext:blade.php,tar.gz", "", "(ends_with(name_folded, '.blade.php') OR ends_with(name_folded, '.tar.gz'))")
add_search("flt4_size_range", "kind:file size:10mb..20mb", "", "kind = 0 AND size BETWEEN 10485760 AND 20971520")
add_search("flt4_size_fraction", "size:>=1.5mb size:<2mb", "", "size >= 1572864 AND size < 2097152")
add_search("flt4_size_not_negatable", "!size:>45mb", "", "size > 47185920")
add_search("flt4_size_reversed", "size:2mb..1mb", "", "false")
add_search("flt5_date_exact", "date:1996-03-01", "", "mtime BETWEEN 825638400 AND 825724800")
add_search("flt5_date_range", "date:1996-01-01..1996-06-30", "", "mtime BETWEEN 820454400 AND 836179200")
add_search("flt5_date_after", "date:>2001-06-01", "", "mtime > 991353600")
add_search("flt5_date_week", "date:week", "", f"mtime >= {NOW - 7 * 86400}")
add_search("flt6_category", "cat:docs", "", "category = 3")
add_search("flt6_category_negated", "!cat:code !cat:other kind:symlink", "", "category NOT IN (7, 0) AND kind = 2")
add_search("flt6_two_categories", "cat:code cat:video", "", "false")
add_search("flt7_path", "path:Brand#1 ext:zig", "", "contains(dir_path, 'Brand#1') AND ends_with(name_folded, '.zig')")
add_search("flt7_path_negated", "!path:/data kind:file", "", "NOT contains(dir_path, '/data') AND kind = 0")
add_search("flt8_combination", "ext:pdf ext:csv !ext:lock !kind:folder size:>1kb order", "order", "(ends_with(name_folded, '.pdf') OR ends_with(name_folded, '.csv')) AND NOT ends_with(name_folded, '.lock') AND kind <> 1 AND size > 1024")
add_search("flt9_scope", "", "", scope="/data/asia")
add_search("flt9_scope_slash", "", "", scope="/data/asia")
add_search("flt9_scope_boundary", "", "", scope="/lost/x1")
add_search("flt10_listing", "", "", scope="/data", depth=1)
add_search("flt10_listing_root", "", "", scope="/", depth=1)
add_search("flt13_everything_by_depth", "", "", depth=2, cap=500)
add_search("lim1_cap", "order", "order", cap=250)
add_search("lim1_cap_in_order", "order", "order", cap=250)
add_search("lim1_cap_in_order_scope", "order_1", "order_1", scope="/data/asia", cap=40)
_BY_FILES |= {"lim1_cap_in_order": ("order", "/", 250), "lim1_cap_in_order_scope": ("order_1", "/data/asia", 40)}
add("flt9_scope_slash", lambda c: search(c.entries, "", "/data/asia/", MAX_DEPTH, 100_000).select("entry_id", *RESULT), _REGISTRY["flt9_scope_slash"][1])
add("flt10_folder_listing", lambda c: list_folder(c.entries, "/docs").select("entry_id", *RESULT), f"SELECT entry_id, {ROW} FROM entries WHERE dir_path = '/docs'")
add("flt11_subtree_through_folders", lambda c: sets.subtree_entries(c.entries, c.tree, "/docs").select("entry_id", *RESULT), f"SELECT entry_id, {ROW} FROM entries WHERE dir_path = '/docs' OR starts_with(dir_path, '/docs/')")
add("flt12_category_partition", lambda c: matching(c.entries, "cat:archives order_7", now=NOW).select("entry_id", *RESULT), f"SELECT entry_id, {ROW} FROM entries WHERE category = 8 AND contains(name_folded, 'order_7')")
add("flt13_empty", lambda c: search(c.entries, "   ").select("entry_id", *RESULT), f"SELECT entry_id, {ROW} FROM entries WHERE false")
add("flt14_path_under", lambda c: c.entries.select("entry_id", names.is_under(F.col("dir_path"), "/lost/x1").alias("under")), "SELECT entry_id, dir_path = '/lost/x1' OR starts_with(dir_path, '/lost/x1/') AS under FROM entries")
add("flt_not_a_qualifier", lambda c: search(c.entries, "size:abc date:>=2024-01-01 foo:bar").select("entry_id", *RESULT), f"SELECT entry_id, {ROW} FROM entries WHERE contains(name_folded, 'size:abc date:>=2024-01-01 foo:bar')")

# --- parser: criteria of query strings, printed again ------------------------------------------------------------------
QUERIES = ("kind:DIR hello  world", "!ext:SVG,Webp", "size:1mb..10mb", "size:>1.5mb", "size:1kb", "date:>2024-01-01", "date:today", "date:2024-02-29", "cat:sheets", "!path:Src/", "date:2024-02-31", "size:99999999999999999tb", "ext:,", "!!kind:file", "KIND:link size:<=5000b")
PRINTED = ("kind:folder|hello world", "!ext:svg,webp|", "size:1mb..10mb|", "size:>1536kb|", "size:1kb|", "date:>2024-01-01|", "date:today|", "date:2024-02-29..2024-02-29|", "cat:spreadsheets|", "!path:Src/|", "|date:2024-02-31", "|size:99999999999999999tb", "|ext:,", "|!!kind:file", "kind:symlink size:<=4.9kb|")


def _printed(c: Catalog) -> DataFrame:
    parsed = [(q, parse(q, NOW)) for q in QUERIES]
    return c.spark.createDataFrame([(q, " ".join(format_criterion(x, NOW) for x in p.criteria) + "|" + p.text) for q, p in parsed], "query string, printed string")


add("prs1_parse_and_print", _printed, "SELECT * FROM (VALUES " + ", ".join(f"('{_quoted(q)}', '{_quoted(p)}')" for q, p in zip(QUERIES, PRINTED, strict=True)) + ") t(query, printed)")
FILTERS = ("Cat:AUDIO ext:ogg live ext:FLAC", "tour ext:SVG,webp", "!ext:log,tmp minutes size:>3mb", "cat: ext: x", "cat:a cat:b")
ENCODED = ("cat:audio ext:flac ext:ogg live", "ext:svg,webp tour", "!ext:log,tmp minutes size:>3mb", "x", "cat:b")
add("prs12_structured_filter", lambda c: c.spark.createDataFrame([(q, StructuredFilter.parse(q).encoded) for q in FILTERS], "query string, encoded string"), "SELECT * FROM (VALUES " + ", ".join(f"('{q}', '{e}')" for q, e in zip(FILTERS, ENCODED, strict=True)) + ") t(query, encoded)")

# --- sorts: with a rank, as rows are compared in no order -----------------------------------------------------------------
_ENGINE = {"name": f"{LOWER.format('name')}", "size": "size", "mtime": "mtime", "category": "list_extract([" + ", ".join(f"'{n}'" for n in CATEGORY_NAMES) + "], category + 1)"}
_FOLDER = "CASE WHEN kind = 1 THEN 0 ELSE 1 END"


def _ranked(rows: DataFrame, keys: list) -> DataFrame:
    # at most a screenful
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(*keys, "entry_id"))).select("rank", "entry_id", *RESULT)


def add_sorted(name: str, column: str, ascending: bool, folders: bool) -> None:
    """The order of all entries."""
    key, way = _ENGINE[column], "ASC" if ascending else "DESC"
    order = ", ".join([*([_FOLDER] if folders else []), f"{key} {way}", f"{_ENGINE['name']} ASC", "dir_path ASC", "entry_id"])
    add(name, lambda c: rank_rows(c.entries.select("entry_id", *RESULT), [*engine_order(column, ascending, folders), F.col("entry_id")]), f"SELECT row_number() OVER (ORDER BY {order}) AS rank, entry_id, {ROW} FROM entries")


for _column in _ENGINE:
    add_sorted(f"srt1_{_column}_asc", _column, True, False)
    add_sorted(f"srt1_{_column}_desc_folders", _column, False, True)

_EXT = "CASE WHEN kind = 1 THEN '' ELSE lower(regexp_extract(name, '(?s)^.+[.]([^.]*)$', 1)) END"
_LABEL = "CASE WHEN kind = 1 THEN 'Folder' ELSE list_extract([" + ", ".join(f"'{n}'" for n in CATEGORY_LABELS) + "], category + 1) END"
_SCREEN = {"name": "lower(name)", "size": "size", "modified": "mtime", "kind": _LABEL, "ext": _EXT}


def add_screen_sorted(name: str, column: str, ascending: bool, on_top: bool) -> None:
    way = "ASC" if ascending else "DESC"
    first = [_FOLDER] if on_top or (column == "name" and ascending) else []
    order = ", ".join([*first, f"{_SCREEN[column]} {way}", *(["lower(name) ASC"] if column != "name" else []), "entry_id"])
    add(name, lambda c: _ranked(search(c.entries, "o", max_results=2000, now=NOW), screen_sort_keys(column, ascending, on_top)), f"SELECT row_number() OVER (ORDER BY {order}) AS rank, entry_id, {ROW} FROM (SELECT * FROM entries WHERE contains(name_folded, 'o') ORDER BY entry_id LIMIT 2000)")


for _column in _SCREEN:
    add_screen_sorted(f"srt2_{_column}_asc", _column, True, False)
    add_screen_sorted(f"srt2_{_column}_desc_on_top", _column, False, True)
_REGISTRY["lim2_cap_then_sort"] = _REGISTRY["srt2_size_asc"]

# --- projections and scalars ------------------------------------------------------------------------------------------------
add("prj2_display_name", lambda c: c.entries.select("entry_id", *(names.display_name(F.col("dir_path"), F.col("name"), s, f).alias(n) for n, s, f in (("below", "/data/asia/", False), ("root", "/", False), ("full_path", "/data", True)))), """
SELECT entry_id, CASE WHEN dir_path = '/data/asia' THEN name WHEN starts_with(dir_path, '/data/asia/') THEN substr(dir_path, 12) || '/' || name ELSE dir_path || '/' || name END AS below,
  CASE WHEN dir_path = '/' THEN name ELSE substr(dir_path, 2) || '/' || name END AS root, dir_path || '/' || name AS full_path FROM entries""")
add("prj5_row_labels", lambda c: c.entries.select("entry_id", names.join_path(F.col("dir_path"), F.col("name")).alias("path"), names.kind_label(F.col("kind"), F.col("category")).alias("kind_label"), names.extension_text(F.col("name"), F.col("kind")).alias("ext_text")), f"SELECT entry_id, CASE WHEN dir_path = '/' THEN '/' || name ELSE dir_path || '/' || name END AS path, {_LABEL} AS kind_label, CASE WHEN {_EXT} = '' THEN '—' ELSE {_EXT} END AS ext_text FROM entries")
add("prj7_selection_summary", lambda c: c.entries.select("entry_id", F.concat("name", F.lit(" — "), names.kind_label(F.col("kind"), F.col("category")), F.when(F.col("kind") == DIRECTORY, "").otherwise(F.concat(F.lit(" · "), h.decimal_bytes(F.col("size"))))).alias("summary")), f"""
SELECT entry_id, name || ' — ' || {_LABEL} || CASE WHEN kind = 1 THEN '' ELSE ' · ' || CASE WHEN size >= 1000000000000 THEN printf('%.1f TB', size / 1e3 / 1e3 / 1e3 / 1e3) WHEN size >= 1000000000 THEN printf('%.1f GB', size / 1e3 / 1e3 / 1e3) WHEN size >= 1000000 THEN printf('%.1f MB', size / 1e3 / 1e3) WHEN size >= 1000 THEN printf('%.1f KB', size / 1e3) ELSE size || ' B' END END AS summary FROM entries""")
add("scl1_fold", lambda c: c.entries.select("entry_id", folded(F.concat("dir_path", F.lit("/ΣΟΦΌΣ-ẞKſİ"), "name")).alias("folded")), f"SELECT entry_id, {FOLD.format("dir_path || '/ΣΟΦΌΣ-ẞKſİ' || name")} AS folded FROM entries")
add("scl2_fold_table", lambda c: c.spark.createDataFrame([(ord(a), ord(b)) for a, b in zip(*tables(), strict=True)], "source int, target int").agg(F.count("*").alias("n"), F.sum("source").alias("sources"), F.sum("target").alias("targets")), f"SELECT len('{tables()[0]}') AS n, CAST(list_sum(list_transform(string_split('{tables()[0]}', ''), lambda c: unicode(c))) AS BIGINT) AS sources, CAST(list_sum(list_transform(string_split('{tables()[1]}', ''), lambda c: unicode(c))) AS BIGINT) AS targets")
add("scl3_ascii_lower", lambda c: c.entries.select("entry_id", F.translate("name", ASCII_UPPER, ASCII_LOWER).alias("lowered")), f"SELECT entry_id, {LOWER.format('name')} AS lowered FROM entries")
add("scl4_extension", lambda c: c.entries.select("entry_id", names.extension(F.col("name")).alias("ext")), "SELECT entry_id, nullif(regexp_extract(name, '(?s)^.+[.]([^.]+)$', 1), '') AS ext FROM entries")
add("scl5_categorize", lambda c: c.entries.groupBy("category", names.categorize(F.col("name")).alias("by_name")).agg(F.count("*").alias("n")), f"SELECT category, CAST(coalesce(c.c2, 0) AS INTEGER) AS by_name, count(*) AS n FROM entries LEFT JOIN (SELECT ext AS e2, category AS c2 FROM cats) c ON e2 = {LOWER.format("regexp_extract(name, '(?s)^.+[.]([^.]+)$', 1)")} GROUP BY ALL")
add("scl6_escape", lambda c: c.entries.select("entry_id", names.escape_tsv(F.concat("name", F.lit("\\t\t\n"))).alias("escaped"), names.unescape_tsv(F.concat(names.escape_tsv(F.col("name")), F.lit(r"\x\\t\t\n\\"))).alias("back")), "SELECT entry_id, replace(replace(replace(name || '\\t' || chr(9) || chr(10), '\\', '\\\\'), chr(9), '\\t'), chr(10), '\\n') AS escaped, name || '\\x\\t' || chr(9) || chr(10) || '\\' AS back FROM entries")
_SIZE2 = "(size * 9000)"
add("scl7_binary_bytes", lambda c: c.entries.select("entry_id", h.binary_bytes(F.col("size") * 9000).alias("said")), "SELECT entry_id, CASE " + " ".join(f"WHEN {_SIZE2} >= {1 << (10 * k)} THEN ({_SIZE2} >> {10 * k}) || '.' || (((({_SIZE2} >> {10 * (k - 1)}) & 1023) * 10) >> 10) || ' {u}'" for k, u in ((5, "PiB"), (4, "TiB"), (3, "GiB"), (2, "MiB"), (1, "KiB"))) + f" ELSE {_SIZE2} || ' B' END AS said FROM entries WHERE true")
add("scl8_duration", lambda c: c.entries.select("entry_id", h.duration(F.col("mtime") % 200_000 - 10).alias("said")), "SELECT entry_id, CASE WHEN ms < 1000 THEN ms || 'ms' WHEN ms < 60000 THEN (ms // 1000) || '.' || (ms % 1000 // 100) || 's' ELSE (ms // 60000) || 'm ' || lpad(CAST(ms // 1000 % 60 AS VARCHAR), 2, '0') || 's' END AS said FROM (SELECT entry_id, greatest(mtime % 200000 - 10, 0) AS ms FROM entries)")
add("scl9_count", lambda c: c.entries.select("entry_id", h.count(F.col("size")).alias("commas"), h.spaced_count(F.col("size")).alias("blanks")), "SELECT entry_id, format('{:,}', size) AS commas, replace(format('{:,}', size), ',', ' ') AS blanks FROM entries")
add("scl10_decimal_bytes", lambda c: c.entries.select("entry_id", h.decimal_bytes(F.col("size")).alias("said")), "SELECT entry_id, CASE WHEN size >= 1000000000 THEN printf('%.1f GB', size / 1e3 / 1e3 / 1e3) WHEN size >= 1000000 THEN printf('%.1f MB', size / 1e3 / 1e3) WHEN size >= 1000 THEN printf('%.1f KB', size / 1e3) ELSE size || ' B' END AS said FROM entries")
add("scl11_age", lambda c: c.entries.select("entry_id", h.age(F.col("mtime"), NOW).alias("said")), f"SELECT entry_id, CASE WHEN days < 1 THEN 'today' WHEN days < 30 THEN days || 'd ago' WHEN days < 365 THEN (days // 30) || 'mo ago' ELSE (days // 365) || 'y ago' END AS said FROM (SELECT entry_id, greatest(({NOW} - mtime) // 86400, 0) AS days FROM entries)")
add("scl12_freshness", lambda c: c.entries.select("entry_id", h.freshness(F.col("mtime"), NOW).alias("said")), f"SELECT entry_id, CASE WHEN m < 1 THEN 'just now' WHEN m < 60 THEN m || 'm' WHEN m < 1440 THEN (m // 60) || 'h' WHEN m < 43200 THEN (m // 1440) || 'd' WHEN m < 525600 THEN (m // 43200) || 'mo' ELSE (m // 525600) || 'y' END AS said FROM (SELECT entry_id, greatest({NOW} - mtime, 0) // 60 AS m FROM entries)")
add("scl14_iso_date", lambda c: c.entries.select("entry_id", h.utc_date(F.col("mtime")).alias("day"), h.epoch_day(F.col("mtime")).cast("long").alias("days")), "SELECT entry_id, strftime(to_timestamp(mtime) AT TIME ZONE 'UTC', '%Y-%m-%d') AS day, mtime // 86400 AS days FROM entries")
add("scl16_category_names", lambda c: c.entries.select("category", names.category_name(F.col("category")).alias("name"), names.category_key(F.col("category")).alias("key")).distinct(), "SELECT DISTINCT category, list_extract([" + ", ".join(f"'{n}'" for n in CATEGORY_NAMES) + "], category + 1) AS name, lower(list_extract([" + ", ".join(f"'{n}'" for n in CATEGORY_NAMES) + "], category + 1)) AS key FROM entries")
add("scl17_bytes_prefix_suffix", lambda c: c.entries.select("entry_id", F.col("name").startswith("order").alias("head"), F.col("name").endswith(".zig").alias("tail"), F.col("name").contains("_1").alias("inside"), (F.col("name") == "index").alias("same")), "SELECT entry_id, starts_with(name, 'order') AS head, ends_with(name, '.zig') AS tail, contains(name, '_1') AS inside, name = 'index' AS same FROM entries")
add("scl18_preview_text", lambda c: c.entries.where("kind = 0").select("entry_id", names.preview_text(F.col("name").cast("binary"), 8).alias("text"), names.preview_highlighted(F.col("name").cast("binary"), 12, 8).alias("highlighted")), """
SELECT entry_id, CASE WHEN n <= 8 THEN name ELSE name[1:k] || CASE WHEN octet_length(encode(name[1:k])) < 8 THEN chr(65533) ELSE '' END || chr(10) || chr(10) || '— Preview truncated at 8 bytes —' || chr(10) END AS text, n <= 8 AS highlighted
FROM (SELECT entry_id, name, octet_length(encode(name)) AS n, list_max(list_filter(range(0, 9), lambda k: octet_length(encode(name[1:k])) <= 8)) AS k FROM entries WHERE kind = 0)""")
add("scl19_preview_format", lambda c: c.entries.select("entry_id", names.preview_format(F.col("name"), F.col("kind")).alias("format")), "SELECT entry_id, CASE WHEN kind = 1 THEN NULL ELSE CASE lower(regexp_extract(name, '(?s)^.+[.]([^.]*)$', 1)) WHEN 'md' THEN 'markdown' WHEN 'markdown' THEN 'markdown' WHEN 'sema' THEN 'sema' WHEN 'json' THEN 'json' END END AS format FROM entries")
add("scl20_terminals", lambda c: c.spark.createDataFrame([(None,), ("",), ("kitty",), ("Warp",)], "configured string").select("configured", F.array_join(sets.terminals(F.col("configured")), ",").alias("tried")), "SELECT * FROM (VALUES (NULL, 'iTerm,Ghostty,WezTerm,kitty,Alacritty,Terminal'), ('', 'iTerm,Ghostty,WezTerm,kitty,Alacritty,Terminal'), ('kitty', 'kitty,iTerm,Ghostty,WezTerm,Alacritty,Terminal'), ('Warp', 'Warp,iTerm,Ghostty,WezTerm,kitty,Alacritty,Terminal')) t(configured, tried)")

# --- aggregates -----------------------------------------------------------------------------------------------------------------
add("agg1_histogram", lambda c: c.histogram, "SELECT dir_path, category, cnt FROM hist")
_HIST = "SELECT c.category, CAST(coalesce(sum(hist.cnt), 0) AS BIGINT) AS cnt FROM (SELECT CAST(range AS INTEGER) AS category FROM range(9)) c LEFT JOIN hist ON hist.category = c.category AND ({}) GROUP BY 1"
add("agg2_scoped_histogram", lambda c: facets.histogram(c.histogram, "/data/asia", totals=c.scope_histogram), _HIST.format(_where("", "/data/asia")))
add("agg2_histogram_of_all", lambda c: facets.histogram(c.histogram, totals=c.scope_histogram), _HIST.format("true"))
add("agg2_histogram_of_folder", lambda c: facets.histogram(c.histogram, "/docs", 1), _HIST.format("dir_path = '/docs'"))
add("agg2_histogram_slash", lambda c: facets.histogram(c.histogram, "/docs/", totals=c.scope_histogram), _HIST.format("false"))
add("agg3_ext_breakdown", lambda c: c.ext_breakdown, "SELECT dir_path, category, ext, cnt, first_entry_id, CAST(rn AS INTEGER) AS rn FROM breakdown")
add("agg4_folder_sizes", lambda c: c.dirs.select("dir_path", "local_bytes", "total_bytes"), "SELECT dir_path, local_bytes, total_bytes FROM dirs")
add("agg2_totals_of_scopes", lambda c: c.scope_histogram, "SELECT path AS dir_path, category, CAST(sum(cnt) AS BIGINT) AS cnt FROM scopes JOIN hist ON path = '/' OR dir_path = path OR starts_with(dir_path, path || '/') GROUP BY ALL")
add("agg5_lists_of_scopes", lambda c: c.scope_exts, "SELECT dir_path, category, ext, cnt, CAST(rn AS INTEGER) AS rn FROM (SELECT *, row_number() OVER (PARTITION BY dir_path, category ORDER BY cnt DESC, ext) AS rn FROM (SELECT path AS dir_path, category, ext, CAST(sum(cnt) AS BIGINT) AS cnt FROM scopes JOIN breakdown ON path = '/' OR dir_path = path OR starts_with(dir_path, path || '/') GROUP BY ALL)) WHERE rn <= 32")
add("flt11_folders_in_ranges", lambda c: c.tree.select("dir_path", (F.col("last") - F.col("first") + 1).alias("folders")), "SELECT path AS dir_path, count(*) AS folders FROM scopes JOIN d ON path = '/' OR dir = path OR starts_with(dir, path || '/') GROUP BY 1")
add("agg5_scoped_ext_breakdown", lambda c: facets.extension_breakdown(c.ext_breakdown, "/data", MAX_DEPTH, 7, totals=c.scope_exts), "SELECT ext, cnt, CAST(row_number() OVER (ORDER BY cnt DESC, ext) AS INTEGER) AS rn FROM (SELECT ext, CAST(sum(cnt) AS BIGINT) AS cnt FROM breakdown WHERE category = 7 AND (dir_path = '/data' OR starts_with(dir_path, '/data/')) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 32)")
add("agg5_ext_breakdown_of_folder", lambda c: facets.extension_breakdown(c.ext_breakdown, "/docs/en/src1", 1, 2, 16), "SELECT ext, cnt, CAST(rn AS INTEGER) AS rn FROM breakdown WHERE dir_path = '/docs/en/src1' AND category = 2 AND rn <= 16")
add("agg6_count", lambda c: c.entries.agg(F.count("*").alias("n")), "SELECT count(*) AS n FROM entries")
add("agg7_facets", lambda c: facets.facet_model(c.histogram, c.ext_breakdown, "/data", totals=(c.scope_histogram, c.scope_exts)), """
SELECT category, cnt, rank, coalesce(extensions, '') AS extensions FROM (SELECT category, cnt, row_number() OVER (ORDER BY cnt DESC, category) AS rank FROM (SELECT category, cnt, count(*) OVER () AS n FROM (SELECT category, CAST(sum(cnt) AS BIGINT) AS cnt FROM hist WHERE dir_path = '/data' OR starts_with(dir_path, '/data/') GROUP BY 1)) WHERE category <> 0 OR n = 1) a
LEFT JOIN (SELECT category, string_agg(ext || ':' || cnt, ',' ORDER BY rn) AS extensions FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY cnt DESC, ext) AS rn FROM (SELECT category, ext, CAST(sum(cnt) AS BIGINT) AS cnt FROM breakdown WHERE dir_path = '/data' OR starts_with(dir_path, '/data/') GROUP BY ALL)) WHERE rn <= 16 GROUP BY 1) b USING (category)""")
add("agg8_capped_count", lambda c: search(c.entries, "order", max_results=2000).agg(F.count("*").alias("n"), h.result_count(F.count("*"), 2000).alias("said")), "SELECT least(count(*), 2000) AS n, least(count(*), 2000) || CASE WHEN count(*) >= 2000 THEN '+' ELSE '' END AS said FROM entries WHERE contains(name_folded, 'order')")
add("agg9_distinct_folders", lambda c: c.entries.select("dir_path").distinct(), "SELECT DISTINCT dir_path FROM entries")
add("agg10_posting_lists", lambda c: rollup.posting_lists(c.entries).select("category", "block", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"), "cnt"), "SELECT category, CAST(entry_id // 65536 AS BIGINT) AS block, string_agg(CAST(entry_id AS VARCHAR), ',' ORDER BY entry_id) AS ids, count(*) AS cnt FROM entries GROUP BY ALL")
add("agg12_sample_statistics", lambda c: sets.sample_statistics(c.entries.where("kind = 0"), "category", "size"), "SELECT category, CAST(list_extract(list_sort(list(size)), CAST(floor(count(*) / 2.0) AS BIGINT) + 1) AS BIGINT) AS median, min(size) AS least, max(size) AS most FROM entries WHERE kind = 0 GROUP BY 1")
add("agg11_partial_totals", lambda c: c.entries.groupBy("kind").agg(F.count("*").alias("n"), F.sum("size").alias("bytes")), "SELECT kind, count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes FROM entries GROUP BY 1")

# --- implicit joins, windows, sets ---------------------------------------------------------------------------------------------------
add("jn1_entry_folder", lambda c: sets.with_directory(c.entries, c.dirs).select("entry_id", "dir_path", "total_bytes"), "SELECT entry_id, dir_path, total_bytes FROM entries JOIN dirs USING (dir_path)")
add("jn2_find_folder", lambda c: sets.find_directory(c.dirs, "/data/asia").select("dir_path", "total_bytes"), "SELECT dir_path, total_bytes FROM dirs WHERE dir_path = '/data/asia'")
add("jn3_folder_own_size", lambda c: c.entries.where("kind = 1").select("entry_id", "size"), "SELECT entry_id, size FROM entries WHERE kind = 1")
add("jn4_parents", lambda c: c.dirs.select("dir_path", names.parent(F.col("dir_path")).alias("up")).join(c.dirs.select(F.col("dir_path").alias("up"), F.col("total_bytes").alias("up_bytes")), "up"), "SELECT a.dir_path, a.up, b.total_bytes AS up_bytes FROM (SELECT dir_path, CASE WHEN regexp_extract(dir_path, '^(.*)/[^/]*$', 1) = '' THEN '/' ELSE regexp_extract(dir_path, '^(.*)/[^/]*$', 1) END AS up FROM dirs) a JOIN dirs b ON b.dir_path = a.up")
add("jn5_subtree_semi_join", lambda c: sets.subtree_entries(c.entries, c.tree, "/parts").select("entry_id"), "SELECT entry_id FROM entries WHERE dir_path = '/parts' OR starts_with(dir_path, '/parts/')")
add("jn6_floor_lookup", lambda c: sets.floor_lookup(c.dirs.select("dir_path", F.explode(F.sequence(F.lit(0), F.lit(400), F.lit(37)).cast("array<bigint>")).alias("pos")), sets.name_offsets(c.entries)), """
SELECT p.dir_path, p.pos, o.entry_id FROM (SELECT dir_path, unnest(range(0, 401, 37)) AS pos FROM dirs) p JOIN (SELECT dir_path, entry_id, CAST(coalesce(sum(octet_length(encode(name))) OVER (PARTITION BY dir_path ORDER BY entry_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start, octet_length(encode(name)) AS size FROM entries) o
ON o.dir_path = p.dir_path AND o.start <= p.pos AND p.pos < o.start + o.size""")
add("jn7_posting_membership", lambda c: c.entries.join(c.entries.where("category = 7").select("entry_id"), "entry_id", "left_semi").select("entry_id"), "SELECT entry_id FROM entries WHERE category = 7")
add("jn8_category_lookup", lambda c: c.entries.where("kind != 1").select("entry_id", names.categorize(F.col("name")).alias("category")), "SELECT entry_id, category FROM entries WHERE kind <> 1")
add("jn9_folder_colors", lambda c: sets.with_folder_color(c.entries.where("kind = 1").select("entry_id", "dir_path", "name"), c.spark.createDataFrame([("/data", "#ff0000ff"), ("/docs/en", "#00ff00ff"), ("/gone", "#0000ffff")], "path string, color string")).select("entry_id", "path", "color"), "SELECT entry_id, path, CASE path WHEN '/data' THEN '#ff0000ff' WHEN '/docs/en' THEN '#00ff00ff' END AS color FROM (SELECT entry_id, CASE WHEN dir_path = '/' THEN '/' || name ELSE dir_path || '/' || name END AS path FROM entries WHERE kind = 1)")
add("jn10_exclusions", lambda c: c.entries.join(c.spark.createDataFrame([(n,) for n in files.EXCLUDED_NAMES], "name string"), "name", "left_anti").select("entry_id"), "SELECT entry_id FROM entries WHERE name NOT IN (" + ", ".join(f"'{n}'" for n in files.EXCLUDED_NAMES) + ")")
add("win1_top_extensions", lambda c: c.ext_breakdown.where("rn <= 3").select("dir_path", "category", "ext", "rn"), "SELECT dir_path, category, ext, CAST(rn AS INTEGER) AS rn FROM breakdown WHERE rn <= 3")
add("win2_suppress_repeats", lambda c: sets.suppress_repeats(c.entries.select("dir_path", "entry_id", "category")), "SELECT dir_path, entry_id, category FROM (SELECT *, lag(category) OVER (PARTITION BY dir_path ORDER BY entry_id) AS was FROM entries) WHERE was IS NULL OR was <> category")
add("win3_lengths", lambda c: sets.lengths_from_offsets(sets.name_offsets(c.entries)), "SELECT dir_path, entry_id, CASE WHEN lead(entry_id) OVER (PARTITION BY dir_path ORDER BY entry_id) IS NOT NULL THEN octet_length(encode(name)) END AS length FROM entries")
_A, _B = "size > 20000000", "category = 3"
add("set1_intersect", lambda c: sets.intersect(c.entries.where(_A), c.entries.where(_B)), f"SELECT entry_id FROM entries WHERE {_A} AND {_B}")
add("set2_merge", lambda c: sets.merge(c.entries.where(_A), c.entries.where(_B)), f"SELECT entry_id FROM entries WHERE {_A} OR {_B}")
add("set3_contains_and_count", lambda c: rollup.posting_lists(c.entries).groupBy("category").agg(F.max(sets.contains(F.col("ids"), 1_000_000_000_014)).alias("has"), F.sum("cnt").alias("n")), "SELECT category, bool_or(entry_id = 1000000000014) AS has, count(*) AS n FROM entries GROUP BY 1")
add("set4_union_shards", lambda c: sets.union_shards(*(c.entries.where(f"entry_id % 3 = {k}").select("entry_id", *RESULT) for k in range(3))), f"SELECT entry_id, {ROW} FROM entries")
add("set5_complement", lambda c: sets.complement(c.entries, c.entries.where(_B)), f"SELECT entry_id FROM entries WHERE NOT ({_B})")

# --- sources and sinks -------------------------------------------------------------------------------------------------------------------
_NAMES = ", ".join(f"'{n}'" for n in files.EXCLUDED_NAMES)
add("src3_scan_exclusions", lambda c: files.without_excluded(c.entries).select("entry_id"), f"""
SELECT entry_id FROM entries WHERE name NOT IN ({_NAMES}) AND NOT starts_with(name, '.') AND NOT (kind = 1 AND (regexp_matches(CASE WHEN dir_path = '/' THEN '/' || name ELSE dir_path || '/' || name END, '(^|/)Library/(Caches|Logs|Developer)$')))
  AND NOT regexp_matches(dir_path, '(^|/)Library/(Caches|Logs|Developer)(/|$)') AND len(list_filter(string_split(dir_path, '/'), lambda p: starts_with(p, '.') OR p IN ({_NAMES}))) = 0""")
add("src5_shard_round_trip", lambda c: _shards_read(c), f"SELECT {ROW} FROM entries")
add("src9_count", lambda c: c.spark.createDataFrame([(c.count(),)], "n bigint"), "SELECT count(*) AS n FROM entries")
add("src8_columns", lambda c: c.entries.select("entry_id", "name", "name_folded", "dir_path", "size", "mtime"), "SELECT entry_id, name, name_folded, dir_path, size, mtime FROM entries")
add("snk4_shard_lines", lambda c: shards.shard_lines(c.entries), "SELECT replace(replace(replace(name, '\\', '\\\\'), chr(9), '\\t'), chr(10), '\\n') || chr(9) || replace(replace(replace(dir_path, '\\', '\\\\'), chr(9), '\\t'), chr(10), '\\n') || chr(9) || size || chr(9) || mtime || chr(9) || kind || chr(9) || category AS value FROM entries")


add("src7_open_snapshot", lambda c: Catalog(c.spark, c.root).entries.groupBy("category").agg(F.count("*").alias("n"), F.min("entry_id").alias("first"), F.max("entry_id").alias("last")), "SELECT category, count(*) AS n, min(entry_id) AS first, max(entry_id) AS last FROM entries GROUP BY 1")
add("snk1_snapshot_entries", lambda c: _rebuilt(c).entries.select("entry_id", *RESULT, "name_folded"), f"SELECT entry_id, {ROW}, name_folded FROM entries")
add("snk3_snapshot_agrees", lambda c: _agreement(_rebuilt(c)), "SELECT dir_path, CAST((SELECT count(*) FROM entries) AS BIGINT) AS published, sum(cnt) AS listed, any_value(total_bytes) AS total_bytes FROM hist JOIN dirs USING (dir_path) GROUP BY 1")


def _rebuilt(c: Catalog) -> Catalog:
    """A snapshot of the catalog's own entries, in a catalog of its own; once for each that is open."""
    root = f"{c.at}-again"
    if not Store(c.spark, root).read("CURRENT"):
        build(c.entries.select(*RAW.names), root, expected=c.count())
    return Catalog(c.spark, root)


def _agreement(c: Catalog) -> DataFrame:
    """Each folder's entries and bytes, beside how many entries the snapshot says it has."""
    listed = c.histogram.groupBy("dir_path").agg(F.sum("cnt").alias("listed"))
    return listed.join(c.dirs, "dir_path").select("dir_path", F.lit(c.count()).cast("long").alias("published"), "listed", "total_bytes")


def _shards_read(c: Catalog) -> DataFrame:
    at = f"{c.at}-shards"
    shards.write_shards(c.entries, at)
    return shards.read_shards(c.spark, at).select(*RESULT)


_NEXT = "CASE WHEN entry_id % 11 = 0 THEN mtime + 1 ELSE mtime END"
_PATH = "CASE WHEN dir_path = '/' THEN '/' || name ELSE dir_path || '/' || name END"
_STATE = "count(*) AS n, min((CASE WHEN kind = 1 THEN 0 ELSE size END, mtime, kind)) AS least, max((CASE WHEN kind = 1 THEN 0 ELSE size END, mtime, kind)) AS most"
add("str1_changes", lambda c: watch.changes(c.entries, _next_scan(c.entries)), f"""
SELECT path, change FROM (SELECT path, CASE WHEN a.n IS NULL THEN 'added' WHEN b.n IS NULL THEN 'removed' WHEN (a.n, a.least, a.most) <> (b.n, b.least, b.most) THEN 'modified' END AS change
FROM (SELECT {_PATH} AS path, {_STATE} FROM entries GROUP BY 1) a
FULL JOIN (SELECT path, {_STATE} FROM (SELECT {_PATH} AS path, kind, size, {_NEXT} AS mtime FROM entries WHERE entry_id % 7 <> 0 UNION ALL SELECT {_PATH} || '.new', kind, size, mtime FROM entries WHERE entry_id % 13 = 0) GROUP BY 1) b USING (path)) WHERE change IS NOT NULL""")


def _next_scan(entries: DataFrame) -> DataFrame:
    """What a later scan might give: entries gone, touched and new."""
    later = entries.where("entry_id % 7 != 0").withColumn("mtime", F.expr(_NEXT))
    return later.unionByName(entries.where("entry_id % 13 = 0").withColumn("name", F.concat("name", F.lit(".new"))))


def _replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    second = F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")
    return watch.replay(watch.ticks(events, "event_type", second), 1_704_067_200)


def _dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("path", F.concat(F.lit("/u/"), F.col("user_id").cast("string"), F.lit("/"), "event_type"))
    return watch.relevant(events, "path", "/u/1").groupBy("event_type").agg(F.count("*").alias("dirty"))


DIRTY_SQL = "SELECT event_type, count(*) AS dirty FROM events WHERE user_id <> 1 GROUP BY 1"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    by_files = {name: (lambda spark, sf_dir, q=q, scope=scope, cap=cap: demo.catalog(spark, sf_dir, index_files=0, ordered_files=0).query(q, scope, MAX_DEPTH, cap, NOW).select("entry_id", *RESULT)) for name, (q, scope, cap) in _BY_FILES.items()}
    out = {name: (lambda spark, sf_dir, make=make: make(demo.catalog(spark, sf_dir))) for name, (make, _) in _REGISTRY.items()}
    return out | by_files | {"str2_relevant_changes": _dirty, "str3_rebuild_replay": _replay}


def oracle_sql() -> dict[str, str]:
    return {name: demo.oracle(sql) for name, (_, sql) in _REGISTRY.items() if sql} | {"str2_relevant_changes": DIRTY_SQL}
