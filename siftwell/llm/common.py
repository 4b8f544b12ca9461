"""Helpers that every operator of this subpackage shares."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.materialise import cut, prepare_checkpoints

__all__ = ["FOLD", "LOWER", "UPPER", "cut", "held_out", "join_by_key", "least_by_hash", "scratch", "shuffle_partitions", "table"]

#: A-Z to a-z and nothing else, for `F.translate` and `bytes.translate`.
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
FOLD = bytes.maketrans(UPPER.encode(), LOWER.encode())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables; only Spark's readers touch the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A path in the shared checkpoint folder for tables that a job writes and reads again."""
    return f"{prepare_checkpoints(spark)}/{name}"


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def held_out(doc_id) -> "F.Column":
    """True for the documents whose labels no model may see: crc32(doc_id as text) mod 3 is 1."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def least_by_hash(df: DataFrame, key: str, rows: int) -> DataFrame:
    """The `rows` rows with the least hash of `key`: a sample that no order or partitioning changes.

    A first filter on the hash leaves little more than `rows` rows of the whole table, so the sort
    for the last cut is small however many partitions there are.
    """
    n = df.count()
    if n > rows:
        share = (rows + 8 * rows**0.5 + 16) / n
        df = df.where(F.xxhash64(key) / F.lit(2.0**64) + 0.5 < share)
    return df.orderBy(F.xxhash64(key), key).limit(rows)


#: A key is hot beyond this part of an even partition; at most so many hot keys a partition there are.
HOT_SHARE = 8


def join_by_key(rows: DataFrame, values: DataFrame, on: list[str], weight: str, total: int, how: str = "inner") -> DataFrame:
    """`rows` joined with `values` (one row a key), `how` inner or left, without a task for a hot key.

    `weight` is a column of `values`: how many of the `total` rows of `rows` have the key. Keys of
    more than `total` / (8 x partitions) rows are at most 8 x partitions, whatever the data, so they
    are broadcast and their rows stay where they lie; only the rows of all other keys are shuffled.
    The column `weight` is dropped. Both inputs are used twice: pass written tables.
    """
    hot = F.col(weight) > total // (HOT_SHARE * shuffle_partitions(rows.sparkSession))
    few, rest = F.broadcast(values.where(hot).drop(weight)), values.where(~hot).drop(weight)
    here = rows.join(few, on)
    return here.unionByName(rows.join(F.broadcast(values.where(hot).select(*on)), on, "left_anti").join(rest, on, how))
