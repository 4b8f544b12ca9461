"""Connected components of an undirected graph in bounded rounds of joins."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm.common import cut, join_by_key


def forest(pairs: np.ndarray) -> np.ndarray:
    """Pairs (node, root) that connect what `pairs` connects: at most one a node."""
    if not len(pairs):
        return pairs
    nodes, flat = np.unique(pairs, return_inverse=True)
    edges = flat.reshape(-1, 2)
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[edges[:, 0]], label[edges[:, 1]])
        new = label.copy()
        np.minimum.at(new, label[edges[:, 0]], low)
        np.minimum.at(new, label[edges[:, 1]], low)
        while True:
            jumped = new[new]
            if np.array_equal(jumped, new):
                break
            new = jumped
        if np.array_equal(new, label):
            break
        label = new
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return np.stack([nodes[moved], nodes[label[moved]]], axis=1)


def _thin(batches: Iterator[pa.RecordBatch], most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Replaces each run of up to `most` edges of a partition by its spanning forest."""
    held, n = [], 0

    def out():
        pairs = forest(np.concatenate(held))
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], names=["a", "b"])

    for batch in batches:
        if batch.num_rows:
            held.append(np.stack([batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)], axis=1))
            n += batch.num_rows
        if n >= most:
            yield out()
            held, n = [], 0
    if held:
        yield out()


def thinned(edges: DataFrame) -> DataFrame:
    """Edges (a, b) that connect what `edges` connects: a forest a partition."""
    return edges.mapInArrow(_thin, "a long, b long")


def connected_components(edges: DataFrame, max_rounds: int = 60, thin: bool = True) -> DataFrame:
    """(node, component) for every node of an edge; component is the least node it reaches.

    Alternates the large-star and small-star steps, which end in a star round the least node of
    every component after a number of rounds that grows with the logarithm of its longest chain.
    Each round is two aggregations with map-side partial minima; a hub's edges are joined with its
    minimum by broadcast (`join_by_key`), so neither gathers it in one task. Rounds are cut by
    written tables. Null ends and loops are dropped; an empty table gives no rows. `thin` replaces
    the edges of each partition by a forest first.
    """
    clean = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a is not null and b is not null and a <> b")
    if thin:
        clean = thinned(clean)
    stars = cut(clean.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    for _ in range(max_rounds):
        n = stars.count()
        if not n:
            break
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # `n` counts only the edges up, of which the first join has those of its hubs.
        least = cut(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count_if(F.col("v") > F.col("u")).alias("n")).where("n > 0"))
        up = stars.select(F.col("v").alias("u"), F.col("u").alias("v"))
        large = cut(join_by_key(up, least, ["u"], "n", n).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        low = cut(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")))
        small = join_by_key(large, low, ["u"], "n", n).select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        stars = cut(small)
        state = stars.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    nodes = stars.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(stars.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
