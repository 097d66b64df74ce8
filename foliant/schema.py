"""Schemas, kinds and categories of the file catalog."""

from __future__ import annotations

from pyspark.sql import types as T

FILE, DIRECTORY, SYMLINK = 0, 1, 2
MAX_DEPTH = (1 << 32) - 1

# Categories by number, as shown, as typed in a query, and as a label of one row.
CATEGORY_NAMES = ("Other", "Images", "Text", "Documents", "Spreadsheets", "Audio", "Video", "Code", "Archives")
CATEGORY_KEYS = ("other", "images", "text", "documents", "spreadsheets", "audio", "video", "code", "archives")
CATEGORY_LABELS = ("Other", "Image", "Text", "Document", "Spreadsheet", "Audio", "Video", "Code", "Archive")
FOLDER_LABEL = "Folder"
CATEGORIES = len(CATEGORY_NAMES)

# Extensions of each category.
EXTENSIONS = {
    1: "png jpg jpeg gif webp svg heif heic bmp ico tiff tif psd raw",
    2: "txt md rst log org tex nfo",
    3: "pdf doc docx odt rtf pages epub",
    4: "xls xlsx csv ods numbers tsv",
    5: "mp3 wav aac flac ogg m4a wma aiff opus mid midi",
    6: "mp4 avi mov mkv flv wmv webm m4v mpg mpeg",
    7: "zig sema rs py js ts jsx tsx go c h cpp hpp cc java rb swift kt scala html css scss less json yaml yml toml xml sh bash zsh fish ps1 lua php pl r sql graphql proto vue svelte elm ex exs erl hs ml clj dart nim v asm wasm makefile cmake dockerfile",
    8: "zip tar gz bz2 xz 7z rar zst lz4 dmg iso jar deb rpm",
}
CATEGORY_OF = {ext: category for category, names in EXTENSIONS.items() for ext in names.split()}

RAW = T.StructType([
    T.StructField("entry_id", T.LongType()),
    T.StructField("name", T.StringType()),
    T.StructField("dir_path", T.StringType()),
    T.StructField("size", T.LongType()),
    T.StructField("mtime", T.LongType()),
    T.StructField("kind", T.IntegerType()),
    T.StructField("category", T.IntegerType()),
])
RESULT = ("name", "dir_path", "size", "mtime", "kind", "category")
#: Snapshot schema versions that can be read; the newest is written. Version 6 folds ASCII alone.
SCHEMA_VERSION, OLDEST_VERSION = 7, 6
EXTS_KEPT = 32
EXT_BYTES = 15
