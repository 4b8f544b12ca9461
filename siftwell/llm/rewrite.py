"""Rewriting the text column while every other column stays."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def map_texts(docs: DataFrame, rewrite: Callable[[list[str]], list[str]], text_col: str = "text", rows: int = 1000) -> DataFrame:
    """`docs` with `rewrite` applied to blocks of texts; null texts stay null, and `n_chars`, where
    there is one, becomes the new length."""
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, rows):
                batch = whole.slice(at, rows)
                texts = batch.column(place).to_pylist()
                done = iter(rewrite([t for t in texts if t is not None]))
                new = pa.array([None if t is None else next(done) for t in texts], batch.schema.field(place).type)
                yield batch.set_column(place, batch.schema.field(place), new)

    out = docs.mapInArrow(run, docs.schema)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length(text_col).cast(docs.schema["n_chars"].dataType))
    return out


def keep_rows(docs: DataFrame, keep: Callable[[list[str | None]], list[bool]], text_col: str = "text", rows: int = 1000) -> DataFrame:
    """The rows of `docs` whose text `keep` wants, with all columns. Each row is judged by its own
    text where it lies, so nothing is shuffled and repeated or null ids do no harm."""
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, rows):
                batch = whole.slice(at, rows)
                yield batch.filter(pa.array(keep(batch.column(place).to_pylist()), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
