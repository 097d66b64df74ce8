"""A catalog derived from the test tables, the same in Spark and in SQL, for the registered queries."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.fold import ASCII_LOWER, ASCII_UPPER, tables
from ..functions.names import with_category
from ..schema import CATEGORY_OF, DIRECTORY
from .catalog import Catalog, Store, build
from .shared import shared_dir

ORDER_EXTS = (".PDF", ".csv", ".Xlsx", ".zig", ".md", ".JPG", ".tar.gz", "", ".php", ".blade.php", ".mp3", ".MOV", ".ZIP", ".unheardof")
HOME_NAMES = (".env", "node_modules", "notes.TXT", "Makefile", "x.blade.php")
NOW = 1_700_000_000

_EXT_LIST = ", ".join(f"'{e}'" for e in ORDER_EXTS)
_HOME_LIST = ", ".join(f"'{n}'" for n in HOME_NAMES)

#: Files and links, and some folders, in SQL that both engines read.
FILES_SQL = f"""
SELECT 1000000000000 + o_orderkey AS entry_id, 'order_' || o_orderkey || element(array_of({_EXT_LIST}), CAST(1 + o_orderkey % {len(ORDER_EXTS)} AS INTEGER)) AS name, '/data/' || lower(r_name) || '/' || lower(n_name) || '/' || lower(c_mktsegment) AS dir_path,
  CAST(round(o_totalprice * 100) AS BIGINT) AS size, epoch_of(o_orderdate) AS mtime, CASE WHEN o_orderkey % 17 = 3 THEN 2 ELSE 0 END AS kind
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
UNION ALL
SELECT 2000000000000 + p_partkey, p_name || '_' || p_partkey || '.zig', '/parts/' || p_brand || '/' || p_type, CAST(p_size AS BIGINT) * 1024, 1600000000 + p_partkey * 3600, 0 FROM part
UNION ALL
SELECT 3000000000000 + doc_id, replace(substr(split_part(coalesce(text, ''), ' ', 1), 1, 60), '/', '_') || '_' || doc_id || CASE WHEN doc_id % 10 = 0 THEN '.Été' WHEN doc_id % 10 = 1 THEN '.TXT' ELSE '.txt' END, '/docs/' || coalesce(lang, 'xx') || '/' || coalesce(source, 'none'), coalesce(n_chars, 0), 1700000000 + doc_id * 60, 0 FROM documents
UNION ALL
SELECT 4000000000000 + page_id, CASE WHEN split_part(url, '/', 5) = '' THEN 'index' ELSE split_part(url, '/', 5) END, '/web/' || split_part(url, '/', 3) || '/' || split_part(url, '/', 4), CAST(length(html) AS BIGINT), 1650000000 + page_id, 0 FROM pages
UNION ALL
SELECT 5000000000000 + s_suppkey, 's_' || s_suppkey || '.log', CASE WHEN s_suppkey <= 3 THEN '/lost' ELSE '/lost/x' || (s_suppkey % 3) || '/deep/er' END, s_suppkey * 10, 1400000000 + s_suppkey, 0 FROM supplier
UNION ALL
SELECT 6000000000000 + n_nationkey, element(array_of({_HOME_LIST}), 1 + n_nationkey % {len(HOME_NAMES)}), '/home/' || lower(n_name), CAST(999 AS BIGINT), 1500000000 + n_nationkey, CASE WHEN n_nationkey % 5 = 1 THEN 1 ELSE 0 END FROM nation
UNION ALL
SELECT 6000000001000 + n_nationkey, 'c.bin', '/home/' || lower(n_name) || CASE n_nationkey % 3 WHEN 0 THEN '/Library/Caches/sub' WHEN 1 THEN '/XLibrary/Caches' ELSE '/node_modules/p' END, CAST(7 AS BIGINT), 1500000000 + n_nationkey, 0 FROM nation
"""

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "documents", "pages")


def _spark_sql(text: str) -> str:
    # Spark's split_part makes a list of all words of a text to take the first
    return text.replace("split_part(coalesce(text, ''), ' ', 1)", "substring_index(coalesce(text, ''), ' ', 1)").replace("element(array_of(", "element_at(array(").replace("epoch_of(o_orderdate)", "timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', o_orderdate)")


def _duck_sql(text: str) -> str:
    return text.replace("element(array_of(", "list_extract(list_value(").replace("epoch_of(o_orderdate)", "CAST(epoch(o_orderdate) AS BIGINT)")


def raw_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files and links, and a folder entry for each folder that they lie in or under (none for those in /lost)."""
    files = _with_tables(spark, sf_dir, _spark_sql(FILES_SQL))
    parts = F.split("dir_path", "/")
    above = F.transform(F.sequence(F.lit(2), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    paths = files.select("dir_path").distinct().where(~F.col("dir_path").startswith("/lost")).select(F.explode(above).alias("path")).distinct()
    folders = paths.select(
        (F.lit(10**15) + F.conv(F.substring(F.md5(F.col("path").cast("binary")), 1, 12), 16, 10).cast("long")).alias("entry_id"),
        F.substring_index("path", "/", -1).alias("name"),
        F.regexp_replace(F.regexp_extract("path", "^(.*)/[^/]*$", 1), "^$", "/").alias("dir_path"),
        F.lit(4096).cast("long").alias("size"),
        F.lit(1_450_000_000).cast("long").alias("mtime"),
        F.lit(DIRECTORY).alias("kind"),
    )
    rows = files.unionByName(folders)
    return with_category(rows)


def _with_tables(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    return spark.sql(" ".join(["WITH", ", ".join(f"{t} AS (SELECT * FROM parquet.`{sf_dir}/{t}.parquet`)" for t in TABLES), text]))


_CATS = ", ".join(f"('{e}', {c})" for e, c in CATEGORY_OF.items())
FOLD = f"translate({{}}, '{tables()[0]}', '{tables()[1]}')"
LOWER = f"translate({{}}, '{ASCII_UPPER}', '{ASCII_LOWER}')"

#: CTEs for DuckDB: raw (as scanned), d (folders, own bytes), totals, entries, dirs, hist, breakdown, scopes (folders and all above them).
BASE_SQL = f"""
cats(ext, category) AS (VALUES {_CATS}),
files AS ({_duck_sql(FILES_SQL)}),
paths AS (SELECT DISTINCT array_to_string(p[1:n], '/') AS path FROM (SELECT p, unnest(range(2, len(p) + 1)) AS n FROM (SELECT DISTINCT string_split(dir_path, '/') AS p FROM files WHERE NOT starts_with(dir_path, '/lost')))),
folders AS (SELECT 1000000000000000 + CAST('0x' || substr(md5(path), 1, 12) AS BIGINT) AS entry_id, regexp_extract(path, '([^/]*)$', 1) AS name, CASE WHEN regexp_extract(path, '^(.*)/[^/]*$', 1) = '' THEN '/' ELSE regexp_extract(path, '^(.*)/[^/]*$', 1) END AS dir_path, CAST(4096 AS BIGINT) AS size, CAST(1450000000 AS BIGINT) AS mtime, 1 AS kind FROM paths),
both_kinds AS (SELECT * FROM files UNION ALL SELECT * FROM folders),
raw AS (SELECT b.*, CAST(CASE WHEN kind = 1 THEN 0 ELSE coalesce(cats.category, 0) END AS INTEGER) AS category FROM both_kinds b LEFT JOIN cats ON cats.ext = {LOWER.format("regexp_extract(name, '(?s)^.+[.]([^.]+)$', 1)")}),
d AS (SELECT dir_path AS dir, CAST(sum(CASE WHEN kind <> 1 THEN size ELSE 0 END) AS BIGINT) AS local FROM raw GROUP BY 1),
chains AS (SELECT dir, local, unnest(anc) AS ancestor, generate_subscripts(anc, 1) - 1 AS dist FROM (SELECT dir, local, CASE WHEN dir = '/' THEN ['/'] WHEN NOT starts_with(dir, '/') THEN [dir] ELSE list_concat(list_transform(range(len(string_split(dir, '/')), 1, -1), lambda i: array_to_string(string_split(dir, '/')[1:i], '/')), ['/']) END AS anc FROM d)),
kept AS (SELECT c.*, row_number() OVER (PARTITION BY c.dir ORDER BY dist) - 1 AS r FROM chains c JOIN d p ON p.dir = c.ancestor),
totals AS (SELECT ancestor AS dir_path, CAST(sum(local) AS BIGINT) AS total_bytes FROM kept WHERE r = dist GROUP BY 1),
entries AS (SELECT raw.* EXCLUDE (size), CAST(CASE WHEN kind = 1 THEN coalesce(t.total_bytes, 0) ELSE size END AS BIGINT) AS size, {FOLD.format("name")} AS name_folded FROM raw LEFT JOIN totals t ON kind = 1 AND t.dir_path = CASE WHEN raw.dir_path = '/' THEN '/' || name ELSE raw.dir_path || '/' || name END),
dirs AS (SELECT d.dir AS dir_path, d.local AS local_bytes, t.total_bytes FROM d JOIN totals t ON t.dir_path = d.dir),
hist AS (SELECT dir_path, category, count(*) AS cnt FROM entries GROUP BY ALL),
exts AS (SELECT dir_path, category, entry_id, {FOLD.format("regexp_extract(name, '(?s)^.*[.]([^.]*)$', 1)")} AS ext FROM entries),
counted AS (SELECT dir_path, category, ext, count(*) AS cnt, min(entry_id) AS first_entry_id FROM exts WHERE ext <> '' AND octet_length(encode(ext)) <= 15 GROUP BY ALL),
breakdown AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dir_path, category ORDER BY cnt DESC, first_entry_id) AS rn FROM counted) WHERE rn <= 32),
scopes AS (SELECT DISTINCT CASE WHEN n = 1 THEN '/' ELSE array_to_string(p[1:n], '/') END AS path FROM (SELECT p, unnest(range(1, len(p) + 1)) AS n FROM (SELECT string_split(dir, '/') AS p FROM d WHERE dir <> '/')))
"""


def oracle(text: str) -> str:
    return f"WITH {BASE_SQL} {text}"


_built: dict[tuple[str, str], str] = {}


def catalog(spark: SparkSession, sf_dir: str, **named: object) -> Catalog:
    """The catalog of a folder of test tables, built once in a Spark application and deleted at its end. named: of ``Catalog``."""
    key = spark.sparkContext.applicationId, sf_dir
    if key not in _built:
        root = f"{shared_dir(spark)}/catalog-{uuid.uuid4().hex}"
        build(raw_entries(spark, sf_dir), root, created=NOW)
        Store(spark, root).forget()
        _built[key] = root
    return Catalog(spark, _built[key], hold=False, **named)
