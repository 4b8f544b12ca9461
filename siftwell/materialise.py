"""Cutting lineage in the shared folder that a cluster names."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def prepare_checkpoints(spark: SparkSession) -> str:
    """Points Spark at the folder in spark.checkpoint.dir and returns it.

    Only a single-machine session (tests) may fall back to a folder of its own.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None:
            if not context.master.startswith("local[") and context.master != "local":
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            named = tempfile.mkdtemp(prefix="siftwell-checkpoints-")
        context.setCheckpointDir(named)
    return context.getCheckpointDir()


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a table that a job wrote for itself; one that is not there is no error."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def cut(df: DataFrame) -> DataFrame:
    """The same rows, written once to the shared checkpoint folder.

    What follows reads the files, so a lost executor costs one read and no recomputation, and
    a plan that uses the rows several times does not run their lineage several times.
    """
    prepare_checkpoints(df.sparkSession)
    return df.checkpoint(eager=True)
