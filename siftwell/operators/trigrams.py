"""The trigram index: postings(trigram, file_id) and indexed(file_id) as DataFrames."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.functions.text import binary_name, decoded, fold, indexable
from siftwell.plans.planner import All, Plan


def trigrams_of(text: Column, ignore_case: bool = True) -> Column:
    """The distinct trigrams of a text, across line ends; none below three characters."""
    return F.array_distinct(F.regexp_extract_all(fold(text) if ignore_case else text, F.lit("(?s)(?=(...))"), 1))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file_id, folded text) to (trigram, file_id), each pair once. Same pairs as exploding
    `trigrams_of`, in about half its time: a look-ahead match for every character costs more than
    sorting the characters' codes, three to a number."""
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            ids, grams = [], []
            for file_id, text in zip(batch.column(0)[at : at + 256].to_pylist(), batch.column(1)[at : at + 256].to_pylist()):
                codes = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
                if len(codes) > 2:
                    packed = np.unique((codes[:-2] << 42) | (codes[1:-1] << 21) | codes[2:])
                    ids.append(np.full(len(packed), file_id, dtype=np.int64))
                    grams.append(packed)
            if grams:
                packed = np.concatenate(grams)
                different, place = np.unique(packed, return_inverse=True)
                parts = np.stack([different >> 42, (different >> 21) & 0x1FFFFF, different & 0x1FFFFF], axis=1).astype("<u4")
                names = pa.array([p.tobytes().decode("utf-32-le", "surrogatepass") for p in parts], pa.string())
                yield pa.RecordBatch.from_arrays([names.take(pa.array(place)), pa.array(np.concatenate(ids))], names=["trigram", "file_id"])


def text_of(files: DataFrame) -> Column:
    """The content column as text, whether it is stored as text or bytes."""
    return decoded(F.col("content")) if dict(files.dtypes)["content"] == "binary" else F.col("content")


@dataclass(frozen=True)
class Index:
    """Postings and the ids whose content they cover. `outside`, where it is known, holds the ids of
    all other files that a search may read, so that a search need not look for them."""

    postings: DataFrame
    indexed: DataFrame
    outside: DataFrame | None = None

    def has(self, file_id: int) -> bool:
        return not self.indexed.where(F.col("file_id") == file_id).isEmpty()

    def size(self) -> int:
        return self.indexed.count()


def indexable_files(files: DataFrame) -> DataFrame:
    alive = F.col("alive") if "alive" in files.columns else F.lit(True)
    return files.where(alive & indexable(F.col("path"), F.col("size")))


def build(files: DataFrame, arrange: bool = True) -> Index:
    """Explodes each indexable file's distinct trigrams. With `arrange`, postings are range-partitioned
    and sorted by trigram, so that a stored index is skipped by row-group statistics; a trigram that
    most files hold spans several ranges because file_id takes part in the range."""
    own = indexable_files(files)
    postings = own.select(F.col("file_id").cast("long").alias("file_id"), fold(text_of(files)).alias("text")).mapInArrow(_extract, "trigram string, file_id long")
    if arrange:
        postings = postings.repartitionByRange("trigram", "file_id").sortWithinPartitions("trigram", "file_id")
    return Index(postings, own.select("file_id"))


def closed(index: Index, files: DataFrame) -> Index:
    """The index with the files of `files` that it does not cover, found once for many searches. It
    holds as long as `files` does; `add` and `remove` open it again."""
    alive = F.col("alive") if "alive" in files.columns else F.lit(True)
    return Index(index.postings, index.indexed, files.where(alive & ~binary_name(F.col("path"))).join(index.indexed, "file_id", "left_anti").select("file_id"))


def remove(index: Index, gone: DataFrame) -> Index:
    """Without the files of `gone` (file_id); ids that are not there change nothing."""
    ids = gone.select("file_id").distinct()
    return Index(index.postings.join(ids, "file_id", "left_anti").select("trigram", "file_id"), index.indexed.join(ids, "file_id", "left_anti"))


def add(index: Index, files: DataFrame) -> Index:
    """Adds or replaces files: stale postings of the same ids go first."""
    left, new = remove(index, files), build(files, arrange=False)
    return Index(left.postings.unionByName(new.postings), left.indexed.unionByName(new.indexed))


def by_file(index: Index) -> DataFrame:
    """file_id and its sorted trigrams: the forward form that is stored."""
    return index.postings.groupBy("file_id").agg(F.sort_array(F.collect_set("trigram")).alias("trigrams"))


def frequencies(index: Index) -> DataFrame:
    """trigram, df: in how many files each trigram is."""
    return index.postings.groupBy("trigram").agg(F.count("*").alias("df"))


def candidates(index: Index, plan: Plan, rarest: DataFrame | None = None, demand: int = 8) -> DataFrame | None:
    """file_id of the files that may match, each once; None when nothing narrows.

    Postings hold a pair once, so counting them finds the files that have every trigram with one
    shuffle of ids. A trigram that no file has gives an empty result. With `rarest` (a frequency table), only the
    `demand` rarest of the required trigrams are asked for: still a superset of the matches.
    """
    if isinstance(plan, All):
        return None
    narrowed: list[DataFrame] = []
    if plan.trigrams:
        wanted = sorted(plan.trigrams)
        if rarest is not None and len(wanted) > demand:
            known = {r["trigram"]: r["df"] for r in rarest.where(F.col("trigram").isin(wanted)).collect()}  # a row a required trigram
            wanted = sorted(wanted, key=lambda t: (known.get(t, 0), t))[:demand]
        hits = index.postings.where(F.col("trigram").isin(wanted))
        narrowed.append(hits.groupBy("file_id").agg(F.count("*").alias("n")).where(F.col("n") >= len(wanted)).select("file_id") if len(wanted) > 1 else hits.select("file_id").distinct())
    for branch in plan.either:
        found = [candidates(index, p, rarest, demand) for p in branch]
        if all(f is not None for f in found):
            narrowed.append(reduce(DataFrame.unionByName, found).distinct())
    if not narrowed:
        return None
    return reduce(lambda a, b: a.join(b, "file_id", "left_semi"), narrowed)


def with_unindexed(found: DataFrame, index: Index, files: DataFrame) -> DataFrame:
    """Adds the files that no index covers (too large, empty, unknown to it) and that are no binaries
    by name. A file is in one of the two, so nothing is there twice."""
    outside = index.outside if index.outside is not None else closed(index, files).outside
    return found.select("file_id").unionByName(outside)


#: Most candidates whose ids go into the scan as a filter.
PUSHED_IDS = 4096


def narrow(files: DataFrame, index: Index, plan: Plan, rarest: DataFrame | None = None, most: int = PUSHED_IDS) -> tuple[DataFrame, list[int] | None]:
    """The files that a search must read, and their ids if they are at most `most`.

    So few ids are collected and become a filter on file_id, which reaches the scan: row groups
    whose statistics exclude them are not read, and no content is moved for a join. More candidates
    meet the files in a semi-join. A plan that narrows nothing gives all files.
    """
    found = candidates(index, plan, rarest)
    if found is None:
        return files, None
    pool = with_unindexed(found, index, files)
    ids = [r["file_id"] for r in pool.orderBy("file_id").limit(most + 1).collect()]  # a top-k plan: one job
    if len(ids) > most:
        return files.join(pool, "file_id", "left_semi"), None
    return files.where(F.col("file_id").isin(ids)), sorted(ids)
