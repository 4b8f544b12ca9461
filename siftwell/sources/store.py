"""The stored index and the stored history.

An index is a folder of versions, each written whole before the manifest names it. Readers take
the version that the manifest names, check it, and rebuild if anything is wrong; a half-written
version is never named. All of it goes through Spark's readers and writers and Hadoop's file
system, so the folder may be in any store.
"""

from __future__ import annotations

import hashlib
import json
import os
import sys
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.operators.frecency import merge, prune, to_wide
from siftwell.operators.trigrams import Index

FORMAT = 1
MANIFEST = "manifest.json"


def cache_path(root: str, env: dict[str, str] | None = None, platform: str = sys.platform) -> str | None:
    """Where the index of a tree is kept: outside the tree, one name a root. SIFTWELL_CACHE=off turns
    storing off, any other value is the folder to use."""
    env = dict(os.environ if env is None else env)
    wanted = env.get("SIFTWELL_CACHE", "")
    if wanted.lower() in ("off", "0", "false"):
        return None
    home = env.get("HOME") or env.get("USERPROFILE") or str(Path.home())
    usual = {"win32": env.get("LOCALAPPDATA") or f"{home}/AppData/Local", "darwin": f"{home}/Library/Caches"}.get(platform, env.get("XDG_CACHE_HOME") or f"{home}/.cache")
    whole = os.path.abspath(root)
    name = "".join(c if c.isalnum() or c in "._-" else "_" for c in os.path.basename(whole))[:40]
    return f"{wanted or usual + '/siftwell'}/{name}-{hashlib.sha256(whole.lower().encode()).hexdigest()[:16]}.idx"


def _fs(spark: SparkSession, path: str):
    jvm = spark._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


def _put(spark: SparkSession, path: str, text: str) -> None:
    """Writes beside the file, then renames over it in one step: a reader sees the old or the new one."""
    fs, place = _fs(spark, path)
    beside = f"{path}.{uuid.uuid4().hex}"
    out = fs.create(place(beside), True)
    out.write(bytearray(text.encode()))
    out.close()
    jvm = spark._jvm.org.apache.hadoop.fs
    how = spark.sparkContext._gateway.new_array(jvm.Options.Rename, 1)
    how[0] = jvm.Options.Rename.OVERWRITE
    jvm.FileContext.getFileContext(place(path).toUri(), spark._jsc.hadoopConfiguration()).rename(fs.makeQualified(place(beside)), fs.makeQualified(place(path)), how)


def _get(spark: SparkSession, path: str) -> dict | None:
    """The manifest of a folder; None if there is none or it is not whole."""
    fs, place = _fs(spark, path)
    if not fs.exists(place(f"{path}/{MANIFEST}")):
        return None
    stream = fs.open(place(f"{path}/{MANIFEST}"))
    try:
        return json.loads(bytes(stream.readAllBytes()).decode())
    except ValueError:
        return None
    finally:
        stream.close()


def _clean(spark: SparkSession, path: str, keep: set[str]) -> None:
    """Deletes versions that neither the manifest nor the one before it names: a reader that has
    just read the last manifest still finds its files."""
    fs, place = _fs(spark, path)
    for status in fs.listStatus(place(path)):
        if status.getPath().getName().startswith("v-") and status.getPath().getName() not in keep:
            fs.delete(status.getPath(), True)


def save(index: Index, files: DataFrame, path: str, root: str) -> dict:
    """Writes postings, indexed ids and the files' metadata, then names them in the manifest."""
    spark = files.sparkSession
    version = f"v-{uuid.uuid4().hex}"
    whole = f"{path}/{version}"
    index.postings.repartitionByRange("trigram", "file_id").sortWithinPartitions("trigram", "file_id").write.parquet(f"{whole}/postings")
    index.indexed.write.parquet(f"{whole}/indexed")
    files.drop("content").write.parquet(f"{whole}/files")
    manifest = {"format": FORMAT, "root": root, "version": version, "files": spark.read.parquet(f"{whole}/files").count(), "postings": spark.read.parquet(f"{whole}/postings").count()}
    before = _get(spark, path) or {}
    _put(spark, f"{path}/{MANIFEST}", json.dumps(manifest))
    _clean(spark, path, {version, before.get("version")})
    return manifest


def load(spark: SparkSession, path: str, root: str) -> tuple[Index, DataFrame] | None:
    """The stored index and files, or None: absent, of another format or root, or not whole."""
    try:
        manifest = _get(spark, path)
        if manifest is None or manifest["format"] != FORMAT or manifest["root"] != root:
            return None
        whole = f"{path}/{manifest['version']}"
        postings, indexed, files = (spark.read.parquet(f"{whole}/{n}") for n in ("postings", "indexed", "files"))
        if files.count() != manifest["files"] or postings.count() != manifest["postings"]:
            return None
    except Exception:
        return None
    return Index(postings.select("trigram", "file_id"), indexed.select("file_id")), files


def load_history(spark: SparkSession, path: str) -> DataFrame:
    """touches of a stored history; none if there is none."""
    manifest = _get(spark, path)
    if manifest is None:
        return spark.createDataFrame([], "path string, at_ms long")
    return spark.read.schema("path string, at_ms long").parquet(f"{path}/{manifest['version']}")


def save_history(touches: DataFrame, path: str, now_ms: int) -> None:
    """Folds touches into what is stored now, so writers do not lose each other's. The new table is a
    version of its own, and the manifest names it once it is whole: a crash leaves the old one."""
    spark = touches.sparkSession
    before, version = _get(spark, path) or {}, f"v-{uuid.uuid4().hex}"
    prune(merge(load_history(spark, path), touches), now_ms).where("path <> ''").write.parquet(f"{path}/{version}")
    _put(spark, f"{path}/{MANIFEST}", json.dumps({"format": FORMAT, "version": version}))
    _clean(spark, path, {version, before.get("version")})


def history_json(touches: DataFrame) -> DataFrame:
    """path and its times as JSON: one small object a row, never one for all paths."""
    return to_wide(touches).select("path", F.to_json(F.create_map("path", "times")).alias("history"))
