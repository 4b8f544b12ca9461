"""The bounded sample of labelled documents that the classifiers learn from."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm.common import cut, held_out, least_by_hash

#: Most labelled rows that a model is fitted on.
SAMPLE_ROWS = 20_000
SHINGLE = 5


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, text to doc_id, the least hash of the text's five-word shingles."""
    for batch in batches:
        least = []
        for text in batch.column(1).to_pylist():
            words = text.lower().split()
            runs = [" ".join(words[i : i + SHINGLE]) for i in range(max(1, len(words) - SHINGLE + 1))]
            least.append(min(map(xxhash.xxh3_64_intdigest, runs)) >> 1)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(least, dtype=np.int64))], names=["doc_id", "sketch"])


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, label (0/1), text: at most `rows` labelled documents that are not held out.

    The rows with the least hash of doc_id are taken, so the sample does not depend on order or
    partitions. Copies, exact or near, would count one text many times: of the texts that share
    their least five-word shingle hash only the one with the least doc_id stays. Null labels and
    texts are left out; where a doc_id has several labels the largest counts.
    """
    known = labels.where(F.col(label).isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("label"))
    known = least_by_hash(known, "doc_id", rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    # `known` has at most `rows` rows of two numbers.
    sample = cut(texts.join(F.broadcast(known), "doc_id").select("doc_id", "label", "text").dropDuplicates(["doc_id"]))
    first = sample.select("doc_id", "text").mapInArrow(_sketch, "doc_id long, sketch long").groupBy("sketch").agg(F.min("doc_id").alias("doc_id"))
    return sample.join(F.broadcast(first.select("doc_id")), "doc_id")
