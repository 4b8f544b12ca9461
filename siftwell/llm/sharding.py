"""Sharding along a Hilbert curve through metadata dimensions.

Each metadata dimension is quantised to 2^bits cells: numbers by their quantiles over the whole
table, strings by a hash (equal values share a cell, which is what pruning by equality needs).
The cells' Hilbert index orders the rows, so a run of the order covers a compact box in every
dimension and a reader prunes shards by the minima and maxima of any of them. Runs are cut where
the running size passes multiples of the whole size over the number of shards.

Equal texts form a group. A group takes the metadata of its least doc_id, so its rows lie next
to each other in the order; a group that is small against a shard stays whole, and a large one
is cut by rows like anything else, so one text may fill many shards without one task holding it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftwell.llm.common import cut, join_by_key, shuffle_partitions
from siftwell.llm.hilbert import hilbert_index

SHARDS = 40
#: Bytes that a row takes besides its text.
ROW_BYTES = 16
#: Groups of equal texts up to this share of a shard are never cut.
WHOLE_SHARE = 0.02


def _cells(df: DataFrame, dims: list[str], bits: int) -> list["F.Column"]:
    """A cell number for each dimension; null is cell 0."""
    kinds = dict(df.dtypes)
    cells, numbers = [], [d for d in dims if kinds[d] not in ("string", "binary")]
    probes = [i / (1 << bits) for i in range(1, 1 << bits)]
    cuts = dict(zip(numbers, df.select(*[F.col(d).cast("double") for d in numbers]).approxQuantile(numbers, probes, 1e-3))) if numbers else {}
    for d in dims:
        if d in cuts:
            steps = F.array(*[F.lit(float(v)) for v in sorted(set(cuts[d]))]) if cuts[d] else F.array().cast("array<double>")
            value = F.col(d).cast("double")
            cells.append(F.coalesce(F.size(F.filter(steps, lambda s, v=value: s <= v)), F.lit(0)).cast("long"))
        else:
            cells.append(F.when(F.col(d).isNull(), 0).otherwise(F.pmod(F.xxhash64(d), F.lit(1 << bits))).cast("long"))
    return cells


def shard(docs: DataFrame, shards: int = SHARDS, dims: tuple[str, ...] = ("lang", "source", "size"), bits: int = 6, whole_share: float = WHOLE_SHARE) -> DataFrame:
    """doc_id, size, text_crc32, law (`bytes`), shard, slot, grown_shard (null under this law),
    hilbert for every row of `docs` (doc_id, text and the dimensions; `size` is made here).

    size is the text's UTF-8 bytes (null: none) plus 16; null and empty text have the checksum of
    no bytes. Shards are numbered along the order and slots are gapless from 0 within each. Ties
    of the order are broken by text, then doc_id; rows that tie in all of them are copies, of
    which any order gives the same rows (a number spreads them over the ranges). Texts of very many
    rows meet their group's values by broadcast, so none gathers. An empty table gives no rows.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    others = [d for d in dims if d != "size"]
    slim = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("_text"), F.monotonically_increasing_id().alias("_row"), *others))
    n = slim.count()
    point = F.struct(F.col("doc_id").isNotNull().alias("_known"), F.col("doc_id"), *[F.col(d) for d in others])
    #: The least doc_id of a group speaks for it; partial minima leave one row a group and task.
    text_key = ["_text", "size", "text_crc32"]
    groups = slim.groupBy(*text_key).agg(F.min(point).alias("p"), F.sum("size").alias("_group"), F.count("*").alias("_n"))
    several = cut(groups.where("_n > 1").select(*text_key, "_group", "_n", F.col("p.doc_id").alias("_lead"), *[F.col("p")[d].alias(f"_{d}") for d in others]))
    rows = join_by_key(slim, several, text_key, "_n", n, "left")
    rows = rows.select("doc_id", "size", "text_crc32", "_text", "_row", F.coalesce("_group", "size").alias("_group"), F.when(F.col("_group").isNull(), F.col("doc_id")).otherwise(F.col("_lead")).alias("_lead"), *[F.when(F.col("_group").isNull(), F.col(d)).otherwise(F.col(f"_{d}")).alias(d) for d in others])

    @F.pandas_udf("long")
    def curve(*cells: pd.Series) -> pd.Series:
        return pd.Series(hilbert_index(np.stack([c.to_numpy() for c in cells], axis=1), bits))

    keyed = rows.withColumn("hilbert", curve(*_cells(slim, list(dims), bits)))
    order = ["hilbert", "_lead", "_text", "doc_id", "_row"]
    parts = shuffle_partitions(spark)
    sorted_rows = cut(keyed.select(*order, "size", "text_crc32", "_group").repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()))
    ends = sorted_rows.groupBy("_part").agg(F.sum("size").alias("bytes")).orderBy("_part").collect()  # one row a partition
    total = sum(r["bytes"] for r in ends)
    starts, at = [], 0
    for r in ends:
        starts.append((r["_part"], at))
        at += r["bytes"]
    offsets = spark.createDataFrame(starts, "_part int, _before long")
    run = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = cut(sorted_rows.withColumn("_inside", F.coalesce(F.sum("size").over(run), F.lit(0))).join(F.broadcast(offsets), "_part").withColumn("_at", F.col("_before") + F.col("_inside")))
    #: A group that stays whole is cut where its first row stands.
    most = int(whole_share * total / shards) if total else 0
    small = F.col("_group") <= most
    firsts = cut(placed.where(F.col("_group") > F.col("size")).groupBy(*text_key).agg(F.min(F.when(small, F.col("_at"))).alias("_first"), F.count("*").alias("_n")))
    placed = join_by_key(placed, firsts, text_key, "_n", n, "left")
    middle = F.when(F.col("_first").isNotNull(), F.col("_first") + F.col("_group") / 2).otherwise(F.col("_at") + F.col("size") / 2)
    dealt = placed.withColumn("shard", F.least(F.lit(shards - 1), F.floor(middle * shards / F.lit(max(total, 1)))).cast("int"))
    dealt = cut(dealt.select(*order, "size", "text_crc32", "_part", "shard"))
    local = dealt.groupBy("shard", "_part").count()
    base = local.withColumn("_slot", F.coalesce(F.sum("count").over(Window.partitionBy("shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("shard", "_part", "_slot")
    numbered = dealt.withColumn("_row", F.row_number().over(Window.partitionBy("shard", "_part").orderBy(*order)) - 1).join(base, ["shard", "_part"])
    return numbered.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("_slot") + F.col("_row")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "hilbert")
