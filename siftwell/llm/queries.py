"""The registered queries of this subpackage, one for each operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.llm.ann import ORACLE as ANN_SQL
from siftwell.llm.ann import neighbours
from siftwell.llm.common import table
from siftwell.llm.decontam import ORACLE as CONTAMINATION_SQL
from siftwell.llm.decontam import contamination
from siftwell.llm.licenses import ORACLE as LICENSE_SQL
from siftwell.llm.licenses import licenses
from siftwell.llm.packing import pack_documents
from siftwell.llm.pii import find as find_personal_data
from siftwell.llm.quality import quality
from siftwell.llm.sharding import shard
from siftwell.llm.simhash import near_duplicates
from siftwell.llm.toxicity import toxicity
from siftwell.llm.warc import ORACLE as WARC_SQL
from siftwell.llm.warc import derivatives, responses


def op1_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors of every vector whose vec_id is divisible by 20."""
    return neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash near-duplicate groups of all documents."""
    return near_duplicates(table(spark, sf_dir, "documents"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 1024 tokens."""
    return pack_documents(table(spark, sf_dir, "documents"), with_ids=False)


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents by patterns and a conditional random field."""
    return find_personal_data(table(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents by a factorisation machine."""
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents by maximum-scoring segments."""
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata and conversion records of all pages."""
    return derivatives(responses(table(spark, sf_dir, "pages")))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows in all documents by one automaton."""
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences of all documents, their own or inherited along paths."""
    return licenses(table(spark, sf_dir, "documents"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents dealt to 40 shards along a Hilbert curve."""
    return shard(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ann": op1_ann,
    "op2_simhash": op2_simhash,
    "op3_packing": op3_packing,
    "op4_pii": op4_pii,
    "op5_quality": op5_quality,
    "op6_toxicity": op6_toxicity,
    "op7_warc": op7_warc,
    "op8_decontamination": op8_decontamination,
    "op9_licenses": op9_licenses,
    "op10_sharding": op10_sharding,
}

#: DuckDB SQL where SQL can express the operator.
ORACLES: dict[str, str] = {
    "op1_ann": ANN_SQL,
    "op7_warc": WARC_SQL,
    "op8_decontamination": CONTAMINATION_SQL,
    "op9_licenses": LICENSE_SQL,
}
