"""A file tree as the relation `files`."""

from __future__ import annotations

import contextlib
import re
import warnings
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftwell.functions.text import MAX_DEPTH, MAX_SEARCHABLE_BYTES, SKIP_DIRECTORIES, in_skipped_directory, included
from siftwell.sources.ignore import Rule, ignored, parse_rules

FILE_CAP = 200_000
#: Files with hidden names that one task reads.
HIDDEN_PER_TASK = 256
#: Of Spark's file partitions, in which a file counts as 4 MB at least, one task reads so many, and about so many bytes.
SPLITS_PER_TASK, BYTES_PER_TASK = 64, 32 << 20


def relative(path: Column, root: str) -> Column:
    """A path below `root`, which Spark may have written with a scheme, relative to it."""
    bare = re.escape(root.rstrip("/").split("://", 1)[-1].removeprefix("file:"))
    return F.regexp_replace(path, f"^.*?{bare}/", "")


def keep(files: DataFrame, rules: list[Rule] = (), max_depth: int = MAX_DEPTH) -> DataFrame:
    """Without skipped directories, ignored paths, hidden clutter and what lies too deep."""
    path = F.col("path")
    return files.where(~in_skipped_directory(path) & included(path) & ~ignored(path, list(rules)) & (F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit(""))) <= max_depth))


def capped(files: DataFrame, most: int | None) -> DataFrame:
    """The first `most` files by path: the same set on every run. A top-k plan, not a full sort."""
    return files if most is None else files.orderBy("path").limit(most)


def read_rules(spark: SparkSession, root: str, name: str = ".gitignore") -> list[Rule]:
    """The rules of the root's ignore file; none if there is no such file."""
    content = _read(spark, f"{root.rstrip('/')}/{name}")
    return [] if content is None else parse_rules(content.decode("utf-8", "replace"))


def _read(spark: SparkSession, path: str) -> bytes | None:
    """A small file through Hadoop's file system."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(place):
        return None
    stream = fs.open(place)
    try:
        return bytes(stream.readAllBytes())
    finally:
        stream.close()


def _hidden(spark: SparkSession, root: str, max_depth: int) -> tuple[list[tuple[str, int, int]], list[str]]:
    """Files (path, size, time) and directories whose names start with a dot or an underscore: Spark's
    file sources pass over those. Found by one glob a level, in the JVM; skipped ones are left out."""
    files, folders, base = [], [], root.rstrip("/")
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    fs = fs_path(base).getFileSystem(spark._jsc.hadoopConfiguration())
    for level in range(max_depth + 1):
        if not len(fs.globStatus(fs_path(base + "/*" * (level + 1))) or []):
            break
        for status in fs.globStatus(fs_path(base + "/*" * level + "/[._]*")) or []:
            path = status.getPath().toString()
            if not any(part in SKIP_DIRECTORIES for part in path.removeprefix(base).split("/")):
                if status.isDirectory():
                    folders.append(path)
                else:
                    files.append((path, status.getLen(), status.getModificationTime()))
    return files, folders


def _read_hidden(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, size, mtime_ms) to the same with content, of files that are small enough to search."""
    from pyarrow import fs

    for whole in batches:
        for batch in (whole.slice(i, 16) for i in range(0, whole.num_rows, 16)):
            contents = []
            for path, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                content = None
                if size <= MAX_SEARCHABLE_BYTES:
                    store, place = fs.FileSystem.from_uri(path if "://" in path else "file://" + quote(path.removeprefix("file:")))
                    with contextlib.suppress(FileNotFoundError), store.open_input_stream(place, compression=None) as stream:
                        content = stream.read()
                contents.append(content)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(contents, pa.binary())], names=["path", "size", "mtime_ms", "content"])


def _hidden_files(spark: SparkSession, files: list[tuple[str, int, int]]) -> DataFrame:
    """Files that Spark's own reader passes over, read in tasks."""
    tasks = max(1, -(-len(files) // HIDDEN_PER_TASK))
    listed = spark.createDataFrame(files, "path string, size long, mtime_ms long").repartition(tasks)
    return listed.mapInArrow(_read_hidden, "path string, size long, mtime_ms long, content binary")


def write_tree(files: DataFrame, root: str) -> None:
    """Writes each row (path, content) as a file below `root`; tasks write, each file once."""
    from_root = root.rstrip("/") if "://" in root else "file://" + quote(root.removeprefix("file:").rstrip("/"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(from_root)
        made = set()
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                folder = f"{base}/{path}".rsplit("/", 1)[0]
                if folder not in made:
                    store.create_dir(folder, recursive=True)
                    made.add(folder)
                with store.open_output_stream(f"{base}/{path}", compression=None) as out:
                    out.write(content.encode() if isinstance(content, str) else content)
            yield pa.RecordBatch.from_arrays([batch.column(0)], names=["path"])

    files.select("path", "content").mapInArrow(run, "path string").write.format("noop").mode("overwrite").save()


def read_paths(spark: SparkSession, root: str, paths: list[str]) -> DataFrame:
    """path, content of some files below `root`, and nothing else of the tree."""
    base = root.rstrip("/")
    hidden = [p for p in paths if any(part[:1] in "._" for part in p.split("/"))]
    plain = sorted(set(paths) - set(hidden))
    schema = "path string, content binary"
    out = spark.createDataFrame([], schema)
    if plain:
        escaped = [re.sub(r"([*?\[\]{}\\])", r"\\\1", f"{base}/{p}") for p in plain]
        out = spark.read.format("binaryFile").option("ignoreMissingFiles", "true").load(escaped).select(relative(F.col("path"), root).alias("path"), "content")
    if hidden:
        out = out.unionByName(_hidden_files(spark, [(f"{base}/{p}", 0, 0) for p in hidden]).select(relative(F.col("path"), root).alias("path"), "content"))
    return out


def scan(spark: SparkSession, root: str, cap: int | None = FILE_CAP, max_depth: int = MAX_DEPTH, rules: list[Rule] | None = None) -> DataFrame:
    """file_id, path, size, mtime_ms, content (bytes), alive of the files below `root`.

    Spark lists and reads the tree; names are judged before content is read. Files that Spark
    takes for hidden are listed beside it, however many, and read in tasks. With a `cap`, the first
    paths in byte order are kept, and a warning says when that leaves any out. A file's id is a hash of its path, so that a later scan gives an
    unchanged path the same id.
    """
    files, folders = _hidden(spark, root, max_depth)
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("ignoreMissingFiles", "true").load([root, *folders])
    named = _fewer_tasks(raw).select("path", F.col("length").alias("size"), F.unix_millis("modificationTime").alias("mtime_ms"), "content")
    if files:
        named = named.unionByName(_hidden_files(spark, files))
    named = named.withColumn("path", relative(F.col("path"), root)).dropDuplicates(["path"]) if folders else named.withColumn("path", relative(F.col("path"), root))
    kept = keep(named, read_rules(spark, root) if rules is None else rules, max_depth)
    if cap is not None:
        last = capped(kept.select("path"), cap + 1).agg(F.count("*").alias("n"), F.max("path").alias("path")).first()
        if last["n"] > cap:
            warnings.warn(f"the tree has more than {cap} files; those from {last['path']} on are left out", stacklevel=2)
            kept = kept.where(F.col("path") < last["path"])
    return kept.select(F.xxhash64("path").alias("file_id"), "path", "size", "mtime_ms", "content", F.lit(True).alias("alive"))


def _fewer_tasks(files: DataFrame) -> DataFrame:
    """The same files in tasks of hundreds of small ones: Spark deals a few to each, and a task costs more than they do."""
    size = int(files._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return files.coalesce(max(4 * files.sparkSession.sparkContext.defaultParallelism, size // BYTES_PER_TASK, files.rdd.getNumPartitions() // SPLITS_PER_TASK))


def spread(df: DataFrame) -> DataFrame:
    """A table of fewer files than the session has cores, dealt to all of them: a small file is often
    one row group, which one task reads however many there are. Larger tables stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df


def from_documents(documents: DataFrame, now_ms: int) -> DataFrame:
    """`documents` as files: text under docs/language/source."""
    path = F.concat(F.lit("docs/"), F.col("lang"), F.lit("/"), F.col("source"), F.lit("/doc_"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return documents.select(F.col("doc_id").alias("file_id"), path.alias("path"), F.octet_length("text").cast("long").alias("size"), (F.lit(now_ms) - (F.col("doc_id") * 3571 % 1_209_600) * 1000).alias("mtime_ms"), F.col("text").alias("content"), F.lit(True).alias("alive"))


def from_pages(pages: DataFrame) -> DataFrame:
    """`pages` as files: html under the address without its scheme."""
    return pages.select(F.col("page_id").alias("file_id"), F.regexp_replace("url", "^https?://", "").alias("path"), F.octet_length("html").cast("long").alias("size"), F.lit(None).cast("long").alias("mtime_ms"), F.col("html").alias("content"), F.lit(True).alias("alive"))


def first_of_each(files: DataFrame) -> DataFrame:
    """One row a path: the one with the least id."""
    return files.withColumn("_n", F.row_number().over(Window.partitionBy("path").orderBy("file_id"))).where("_n = 1").drop("_n")
