"""Column functions over paths and content."""

from __future__ import annotations

import os

from pyspark.sql import Column
from pyspark.sql import functions as F

# Directories that are never searched.
SKIP_DIRECTORIES = [
    ".git", ".hg", ".svn", "node_modules", ".venv", "venv", "__pycache__", ".mypy_cache", ".pytest_cache", ".ruff_cache", "dist", "build", "out", "target", ".next", ".nuxt", ".svelte-kit", ".turbo",
    ".cache", ".gradle", ".idea", ".vscode-test", "coverage", ".nyc_output", "vendor", "Pods", ".terraform", ".DS_Store",
]

# Extensions whose content is no text; "lock" is text on purpose.
BINARY_EXTENSIONS = [
    "png", "jpg", "jpeg", "gif", "bmp", "ico", "webp", "avif", "tiff", "psd", "mp3", "mp4", "wav", "ogg", "flac", "avi", "mov", "mkv", "webm", "zip", "gz", "tgz", "bz2", "xz", "7z", "rar", "jar", "war",
    "pdf", "doc", "docx", "xls", "xlsx", "ppt", "pptx", "exe", "dll", "so", "dylib", "bin", "o", "a", "lib", "obj", "pdb", "class", "pyc", "pyo", "wasm", "node", "ttf", "otf", "woff", "woff2", "eot",
    "db", "sqlite", "sqlite3", "pack", "idx",
]

# Size limits in bytes, characters sniffed for NUL, walk depth.
MAX_INDEXABLE_BYTES = 2 * 1024 * 1024
MAX_SEARCHABLE_BYTES = 10 * 1024 * 1024
SNIFF_CHARACTERS = 8192
MAX_DEPTH = 24

#: Characters that case-insensitive regular expressions equate with an ASCII letter though
#: lower-casing does not, and what indexing makes of them.
FOLD_FROM, FOLD_TO = "İıſK", "iisk"


def fold(text: Column) -> Column:
    """The one case folding of index, plan and content."""
    return F.lower(F.translate(text, FOLD_FROM, FOLD_TO))


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def stem(path: Column) -> Column:
    """The name up to its last dot; a name that only starts with a dot is all stem."""
    name = file_name(path)
    return F.regexp_replace(name, r"(?s)^(.+)\.[^.]*$", "$1")


def extension(path: Column) -> Column:
    """After the last dot of the name, lower-case; empty for dot-files."""
    return F.lower(F.regexp_extract(file_name(path), r"(?s)^.+\.([^.]*)$", 1))


def depth(path: Column) -> Column:
    """Number of slashes."""
    return F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit("")))


def normalise(path: Column) -> Column:
    """Forward slashes, without one leading `./`."""
    return F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"^\./", "")


def in_skipped_directory(path: Column) -> Column:
    """Whether any directory of the path (not the name itself) is skipped."""
    parts = F.split(path, "/")
    return F.arrays_overlap(F.slice(parts, 1, F.size(parts) - 1), F.array(*map(F.lit, SKIP_DIRECTORIES)))


def included(path: Column) -> Column:
    name = file_name(path)
    return (name != "") & ~name.startswith(".DS_Store")


def binary_name(path: Column) -> Column:
    return extension(path).isin(BINARY_EXTENSIONS)


def indexable(path: Column, size: Column) -> Column:
    return (size > 0) & (size <= MAX_INDEXABLE_BYTES) & ~binary_name(path)


def searchable(path: Column, size: Column) -> Column:
    return (size <= MAX_SEARCHABLE_BYTES) & ~binary_name(path)


def looks_binary(content: Column) -> Column:
    """Whether a NUL stands among the first characters (of strings) or bytes (of binaries)."""
    return F.instr(F.substring(content, 1, SNIFF_CHARACTERS), "\x00") > 0


def bytes_look_binary(content: Column) -> Column:
    return F.instr(F.substring(content, 1, SNIFF_CHARACTERS).cast("string"), "\x00") > 0


def decoded(content: Column) -> Column:
    """Text of bytes; what is no UTF-8 becomes the replacement character."""
    return F.make_valid_utf8(content.cast("string"))


def trimmed(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(text, r"^[\s ﻿]+|[\s ﻿]+$", "")


def index_key(path: Column, root: str, home: str | None = None) -> Column:
    """An absolute or relative path as the index stores it; null when it lies outside `root`. A
    leading `~` is `home`, the user's own folder unless another is named."""
    root = root.rstrip("/")
    own = (home if home is not None else os.path.expanduser("~")).rstrip("/")
    plain = normalise(path)
    whole = F.when(plain == "~", F.lit(own)).when(plain.startswith("~/"), F.concat(F.lit(own), F.substring(plain, 2, 1 << 30))).otherwise(plain)
    inside = F.when(whole.startswith(root + "/"), F.substring(whole, len(root) + 2, 1 << 30)).when(~whole.startswith("/"), whole)
    # `a/../b` and `.` are resolved part by part; climbing above the root is outside.
    parts = F.filter(F.split(inside, "/"), lambda p: (p != "") & (p != "."))
    start = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(False).alias("out"))
    step = lambda s, p: F.when(p != "..", F.struct(F.array_append(s["kept"], p).alias("kept"), s["out"].alias("out"))).otherwise(F.struct(F.slice(s["kept"], 1, F.greatest(F.size(s["kept"]) - 1, F.lit(0))).alias("kept"), (s["out"] | (F.size(s["kept"]) == 0)).alias("out")))
    walked = F.aggregate(parts, start, step)
    return F.when(~walked["out"] & (F.size(walked["kept"]) > 0), F.array_join(walked["kept"], "/"))
