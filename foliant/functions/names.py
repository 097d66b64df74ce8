"""Expressions over names, extensions and paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import CATEGORY_KEYS, CATEGORY_LABELS, CATEGORY_NAMES, DIRECTORY, EXT_BYTES, EXTENSIONS, FOLDER_LABEL
from .fold import ASCII_LOWER, ASCII_UPPER, folded


def literal_map(values: dict) -> Column:
    return F.create_map(*(F.lit(x) for pair in values.items() for x in pair))


def last_dot(name: Column) -> Column:
    """What stands behind the last dot, "" if there is none."""
    return F.when(F.instr(name, ".") == 0, "").otherwise(F.substring_index(name, ".", -1))


def extension(name: Column) -> Column:
    """Behind the last dot; null without one, with one in front alone, or with nothing behind it."""
    ext = F.substring_index(name, ".", -1)
    return F.when((ext != "") & (F.octet_length(name) > F.octet_length(ext) + 1), ext)


def category_key_of(name: Column) -> Column:
    """The extension as categories list it."""
    return F.translate(extension(name), ASCII_UPPER, ASCII_LOWER)


def category_of(key: Column) -> Column:
    """Category number of a key, 0 if unknown: a few hashed sets, as a map of literals is searched from its front."""
    out = F
    for category, exts in EXTENSIONS.items():
        out = out.when(key.isin(exts.split()), category)
    return out.otherwise(0)


def categorize(name: Column) -> Column:
    """Category number by extension, 0 if unknown."""
    return category_of(category_key_of(name))


def with_category(rows: DataFrame) -> DataFrame:
    """Rows (name, kind) with the category of each, 0 for folders; the key is a column first, so it is made once a row."""
    keyed = rows.withColumn("__key", category_key_of(F.col("name")))
    return keyed.withColumn("category", F.when(F.col("kind") == DIRECTORY, 0).otherwise(category_of(F.col("__key")))).drop("__key")


def bucket_extension(name: Column) -> Column:
    """The extension that breakdowns count: dotfiles and folders have one too; null if empty or too long."""
    return counted_extension(last_dot(name))


def counted_extension(behind: Column) -> Column:
    """The same of what stands behind the last dot."""
    ext = folded(behind)
    return F.when((ext != "") & (F.octet_length(ext) <= EXT_BYTES), ext)


def row_extension(name: Column, kind: Column) -> Column:
    """Lower-case extension that rows are sorted by; "" for folders, dotfiles and names without."""
    return F.when(kind == DIRECTORY, "").otherwise(F.lower(F.regexp_extract(name, r"(?s)^.+[.]([^.]*)$", 1)))


def extension_text(name: Column, kind: Column) -> Column:
    ext = row_extension(name, kind)
    return F.when(ext == "", "—").otherwise(ext)


def _of(names: tuple[str, ...], category: Column) -> Column:
    return F.coalesce(F.element_at(literal_map(dict(enumerate(names))), category), F.lit(names[0]))


def category_name(category: Column) -> Column:
    return _of(CATEGORY_NAMES, category)


def category_key(category: Column) -> Column:
    return _of(CATEGORY_KEYS, category)


def kind_label(kind: Column, category: Column) -> Column:
    return F.when(kind == DIRECTORY, FOLDER_LABEL).otherwise(_of(CATEGORY_LABELS, category))


def join_path(dir_path: Column, name: Column) -> Column:
    """``dir_path/name``, with one slash behind the root."""
    return F.when(dir_path == "/", F.concat(F.lit("/"), name)).otherwise(F.concat(dir_path, F.lit("/"), name))


def parent(path: Column) -> Column:
    """The text before the last slash; "/" if that is the first character; null without a slash."""
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(F.regexp_extract(path, r"(?s)^(.*)/[^/]*$", 1), "^$", "/"))


def is_under(path: Column, folder: str) -> Column:
    """``folder`` itself or anything below it."""
    return (path == folder) | path.startswith(folder + "/")


def relative_dir(dir_path: Column, scope: str) -> Column:
    """The folder as seen from ``scope``: "" for itself, the whole path if it lies elsewhere."""
    scope = strip_slash(scope)
    if scope == "/":
        return F.regexp_replace(dir_path, "^/", "")
    return F.when(dir_path == scope, "").when(dir_path.startswith(scope + "/"), F.substring(dir_path, len(scope) + 2, 1 << 30)).otherwise(dir_path)


def display_name(dir_path: Column, name: Column, scope: str, full: bool) -> Column:
    """Path and name as shown. With ``full`` a name in the root has two slashes."""
    if full:
        return F.concat(dir_path, F.lit("/"), name)
    at = relative_dir(dir_path, scope)
    return F.when(at == "", name).otherwise(F.concat(at, F.lit("/"), name))


def strip_slash(path: str) -> str:
    """Without one slash at the end; the root stays."""
    return path[:-1] if len(path) > 1 and path.endswith("/") else path


def escape_tsv(c: Column) -> Column:
    for plain, code in (("\\", "\\\\"), ("\t", "\\t"), ("\n", "\\n")):
        c = F.replace(c, F.lit(plain), F.lit(code))
    return c


def unescape_tsv(c: Column) -> Column:
    r"""Inverse of escape_tsv; unknown codes stay. Pairs of backslashes are set apart first, so each is read once."""
    parts = F.split(c, r"\\\\", -1)
    return F.array_join(F.transform(parts, lambda p: F.replace(F.replace(p, F.lit("\\t"), F.lit("\t")), F.lit("\\n"), F.lit("\n"))), "\\")


def preview_format(name: Column, kind: Column) -> Column:
    """How a file is previewed: markdown, sema or json; null: by the system."""
    ext = F.lower(F.regexp_extract(name, r"(?s)^.+[.]([^.]*)$", 1))
    return F.when(kind == DIRECTORY, None).when(ext.isin("md", "markdown"), "markdown").when(ext.isin("sema", "json"), ext)


def preview_text(content: Column, limit: int = 20 << 20) -> Column:
    """Text of a file's first bytes, wrong UTF-8 replaced, with a notice where it was cut."""
    cut = F.make_valid_utf8(F.substring(content, 1, limit).cast("string"))
    return F.when(F.octet_length(content) > limit, F.concat(cut, F.lit(f"\n\n— Preview truncated at {limit} bytes —\n"))).otherwise(cut)


def preview_highlighted(content: Column, limit: int = 20 << 20, highlight: int = 5 << 20) -> Column:
    return F.octet_length(content) <= min(limit, highlight)
