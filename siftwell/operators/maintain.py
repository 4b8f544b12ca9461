"""Keeping an index in step with its files: diff, reuse, refresh, forget."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.operators.trigrams import Index, add, remove


@dataclass(frozen=True)
class Stats:
    """How many files kept their stored postings, and how many were read."""

    reused: int
    rebuilt: int


def status(old: DataFrame, new: DataFrame) -> DataFrame:
    """path, file_id, status: new, changed (size or time differ, or it was dead), gone or same."""
    alive = F.col("alive") if "alive" in old.columns else F.lit(True)
    before = old.select("path", F.col("file_id").alias("_old"), F.col("size").alias("_size"), F.col("mtime_ms").alias("_mtime"), alive.alias("_alive"))
    after = new.select("path", F.col("file_id").alias("_new"), "size", "mtime_ms", F.lit(True).alias("_there"))
    same = F.col("size").eqNullSafe(F.col("_size")) & F.col("mtime_ms").eqNullSafe(F.col("_mtime")) & F.col("_alive")
    verdict = F.when(F.col("_there").isNull(), F.when(F.col("_alive"), "gone").otherwise("dead")).when(F.col("_old").isNull(), "new").when(same, "same").otherwise("changed")
    return before.join(after, "path", "full_outer").select("path", F.coalesce("_old", "_new").alias("file_id"), verdict.alias("status")).where("status <> 'dead'")


def reuse(stored: DataFrame, files: DataFrame) -> DataFrame:
    """`files` with reused: whether the stored entry has the same path, size and time."""
    known = stored.select("path", "size", "mtime_ms").distinct().withColumn("_known", F.lit(True))
    return files.join(known, ["path", "size", "mtime_ms"], "left").withColumn("reused", F.col("_known").isNotNull()).drop("_known")


def reconcile(index: Index, old: DataFrame, new: DataFrame) -> tuple[Index, DataFrame, DataFrame]:
    """Index and files brought in step with `new` (with content), and the status of every path.
    Ids of known paths stay; vanished files stay as dead rows; only new and changed files are read."""
    diff = status(old, new)
    touched = diff.where("status in ('new', 'changed')")
    renamed = new.drop("file_id").join(diff.select("path", "file_id"), "path")
    fresh = renamed.join(touched.select("path"), "path", "left_semi")
    gone = diff.where("status = 'gone'")
    left = remove(index, gone.select("file_id").unionByName(touched.select("file_id")))
    merged = add(left, fresh.select("file_id", "path", "size", "mtime_ms", "content", F.lit(True).alias("alive")))
    dead = old.drop("content", "alive").join(new.select("path"), "path", "left_anti").withColumn("alive", F.lit(False))
    files = renamed.drop("content").withColumn("alive", F.lit(True)).select("file_id", "path", "size", "mtime_ms", "alive").unionByName(dead.select("file_id", "path", "size", "mtime_ms", "alive"))
    return merged, files, diff


def stats(diff: DataFrame) -> Stats:
    row = diff.agg(F.count_if(F.col("status") == "same").alias("same"), F.count_if(F.col("status").isin("new", "changed")).alias("read")).first()
    return Stats(row["same"], row["read"])


def dirty(diff: DataFrame, stored: bool) -> bool:
    """Whether the index is worth writing: nothing stored yet, or anything but unchanged files."""
    return not stored or not diff.where("status <> 'same'").isEmpty()


def refresh(index: Index, files: DataFrame, changed: DataFrame) -> tuple[Index, DataFrame]:
    """Some files again (created, modified, revived): `changed` has whole rows with content. The
    caller filters them as a scan does."""
    ids = files.select("path", F.col("file_id").alias("_known"))
    rows = changed.join(ids, "path", "left").withColumn("file_id", F.coalesce("_known", "file_id")).drop("_known")
    others = files.join(rows.select("path"), "path", "left_anti").drop("content")
    return add(index, rows), others.unionByName(rows.drop("content").select(*others.columns))


def forget(index: Index, files: DataFrame, paths: DataFrame) -> tuple[Index, DataFrame]:
    """Marks paths dead; their ids stay theirs and their postings go."""
    gone = paths.select("path").distinct().withColumn("_gone", F.lit(True))
    marked = files.join(gone, "path", "left").withColumn("alive", F.col("alive") & F.col("_gone").isNull()).drop("_gone")
    return remove(index, files.join(gone, "path", "left_semi").select("file_id")), marked.select(*files.columns)
