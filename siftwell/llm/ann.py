"""Nearest neighbours by inner product over shifted space-filling curves.

Index. Equal vectors are folded into one point, which keeps their least ids, so copies cost one
point however many there are. One coordinate is added that makes all points equally long (queries
have zero there), which turns the largest inner product into the least distance. For each of
several curves the points are projected on random directions, shifted at random, quantised and
given their Hilbert index; scales come from a bounded sample, and every point is indexed.

Windows. Spark range-partitions and sorts the keys of all curves by (curve, index), and every key
gets its place along its curve. Places are cut into chunks of `CHUNK`, and a point within `window`
places of a chunk's edge goes to both chunks, so every query sees the whole window on either side
of its own place, however the keys were partitioned. Only keys are sorted and numbered; a vector
moves once for each chunk it belongs to. The curves' windows merge, are scored exactly, and the best
of the union are the neighbours found.

Check. Vectors without structure have no curve that keeps their neighbours near, so an exact
check may follow. Blocks of points along the first curve have a centre and a radius; a small table
of these tells, before any vector moves, which blocks may hold a point that reaches the score of a
query's last neighbour, and only those pairs meet.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftwell.llm.common import cut, join_by_key, least_by_hash, shuffle_partitions
from siftwell.llm.hilbert import hilbert_index

NEIGHBOURS = 20
CURVES = 8
DIRECTIONS, BITS = 6, 10
WINDOW = 1024
#: Places of a curve that one task scores at once (with a window more on either side).
CHUNK = 8192
#: Points whose projections set the scales of the curves.
SAMPLE = 4096
#: Queries and points that meet in one task of the check.
QUERY_BLOCK, POINT_BLOCK = 4096, 4096
SEED = 5


def _packed(kind: type):
    """(id, embedding) to (id, size, norm, vec as bytes of `kind`) of the vectors that take part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sizes, norms, vecs = [], [], [], []
            for vec_id, values in zip(batch.column(0).to_pylist(), batch.column(1)):
                if vec_id is None or not values.is_valid or values.values.null_count or not len(values.values):
                    continue
                v = values.values.to_numpy(zero_copy_only=False).astype(np.float64) + 0.0
                if np.isfinite(v).all() and v.any():
                    ids.append(vec_id)
                    sizes.append(len(v))
                    norms.append(float(v @ v))
                    vecs.append(v.astype(kind).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int32()), pa.array(norms, pa.float64()), pa.array(vecs, pa.binary())], names=["vec_id", "size", "norm", "vec"])

    return run


def _matrix(vecs: list[bytes], size: int) -> np.ndarray:
    """Vectors in double precision; the width of a component follows from the bytes."""
    kind = np.float64 if vecs and len(vecs[0]) == 8 * size else np.float32
    return np.frombuffer(b"".join(vecs), dtype=kind).reshape(-1, size).astype(np.float64)


def exact_scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise inner products, summed in one fixed order, so that equal vectors score equally."""
    total = np.zeros(len(a))
    for k in range(a.shape[1]):
        total += a[:, k] * b[:, k]
    return total


class Curves:
    """Random directions, shifts and the scales of the curves."""

    def __init__(self, sample: np.ndarray, longest: float, curves: int = CURVES, seed: int = SEED):
        random = np.random.default_rng(seed)
        size = sample.shape[1] + 1
        self.longest = longest
        self.directions = [np.linalg.qr(random.normal(size=(size, min(DIRECTIONS, size))))[0] for _ in range(curves)]
        self.shifts = [random.random(d.shape[1]) for d in self.directions]
        full = self._longer(sample, False)
        self.scales = [np.quantile(full @ d, [0.005, 0.995], axis=0) for d in self.directions]

    def _longer(self, vectors: np.ndarray, query: bool) -> np.ndarray:
        extra = np.zeros(len(vectors)) if query else np.sqrt(np.maximum(self.longest - (vectors**2).sum(axis=1), 0))
        return np.column_stack([vectors, extra])

    def keys(self, vectors: np.ndarray, query: bool) -> list[np.ndarray]:
        full, half, out = self._longer(vectors, query), 1 << (BITS - 1), []
        for d, shift, (low, high) in zip(self.directions, self.shifts, self.scales):
            unit = np.clip((full @ d - low) / np.maximum(high - low, 1e-12), 0, 1)
            out.append(hilbert_index(np.minimum((unit + shift) * half, 2 * half - 1).astype(np.int64), BITS))
        return out


def _keyed(grid: Curves, size: int):
    """(point, vec, asks) to (curve, key, point, query): every point, and every query once more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            point, vec = batch.column(0).to_numpy(), _matrix(batch.column(1).to_pylist(), size)
            asks = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            for query in (False, True):
                mine = np.flatnonzero(asks) if query else np.arange(len(asks))
                for c, keys in enumerate(grid.keys(vec[mine], query) if len(mine) else []):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(mine), c, dtype=np.int32)), pa.array(keys), pa.array(point[mine]), pa.array(np.full(len(mine), query))], names=["curve", "key", "point", "query"])

    return run


def _placed(before: dict[tuple[int, int], int], window: int, chunk: int):
    """Rows (curve, point, query, part) of one partition in order to (curve, chunk, place, point,
    query, own). A point's place is the number of points before it on its curve, `before` giving
    those of earlier partitions; it goes to every chunk within `window` of it, and `own` marks the
    one it lies in. A query stands before the point at its place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, int] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            curve, point, query, part = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(4))
            place = np.empty(len(curve), dtype=np.int64)
            for c in np.unique(curve).tolist():
                mine = np.flatnonzero(curve == c)
                is_point = ~query[mine].astype(bool)
                count = np.cumsum(is_point)
                place[mine] = before.get((int(part[0]), c), 0) + seen.get(c, 0) + count - is_point
                seen[c] = seen.get(c, 0) + int(count[-1])
            reach = np.where(query.astype(bool), 0, window)
            first, last = np.maximum(place - reach, 0) // chunk, (place + reach) // chunk
            copies = last - first + 1
            row = np.repeat(np.arange(len(place)), copies)
            number = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(copies) - copies, copies)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (curve[row], number, place[row], point[row], query[row].astype(bool), number == place[row] // chunk)], names=["curve", "chunk", "place", "point", "query", "own"])

    return run


def _windowed(size: int, keep: int, window: int):
    """One chunk's points and queries to (query, point, score): each query's best `keep` of the
    points within `window` places on either side."""

    def run(chunk: pa.Table) -> pa.Table:
        place, point, query = (chunk.column(n).to_numpy() for n in ("place", "point", "query"))
        vec, out = _matrix(chunk.column("vec").to_pylist(), size), []
        data, asked = np.flatnonzero(~query), np.flatnonzero(query)
        data = data[np.argsort(place[data], kind="stable")]
        at, x = place[data], vec[data]
        for i in asked.tolist():
            a, b = np.searchsorted(at, [place[i] - window, place[i] + window])
            if a == b:
                continue
            rough = x[a:b] @ vec[i]
            few = np.arange(a, b)
            if len(few) > keep:
                few = few[rough >= np.partition(rough, -keep)[-keep] - 1e-9 * (1 + np.abs(rough).max())]
            exact = exact_scores(x[few], np.broadcast_to(vec[i], (len(few), size)))
            best = np.lexsort((point[data[few]], -exact))[:keep]
            out.append((np.full(len(best), point[i]), point[data[few]][best], exact[best]))
        cols = [np.concatenate(c) for c in zip(*out)] if out else [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)]
        return pa.table([pa.array(c) for c in cols], names=["query", "point", "score"])

    return run


def _best(rows: DataFrame, keep: int) -> DataFrame:
    """The `keep` best points of each query, each once."""
    order = Window.partitionBy("query").orderBy(F.desc("score"), "point")
    return rows.groupBy("query", "point").agg(F.max("score").alias("score")).withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= keep).drop("_n")


# ---- the exact check ------------------------------------------------------------------------


def _ball(size: int):
    """One block of points to its centre and radius."""

    def run(block: pa.Table) -> pa.Table:
        x = _matrix(block.column("vec").to_pylist(), size)
        centre = x.mean(axis=0)
        radius = float(np.sqrt(((x - centre) ** 2).sum(axis=1).max()))
        return pa.table({"block": block.column("block").slice(0, 1), "centre": pa.array([centre.tobytes()]), "radius": pa.array([radius])})

    return run


def _pairs(size: int, blocks: np.ndarray, centres: np.ndarray, radii: np.ndarray, most: int = 1 << 12):
    """(query, vec, least) to the same with each block that may hold a point that reaches `least`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                q, least = _matrix(batch.column(1).to_pylist(), size), batch.column(2).to_numpy()
                reach = q @ centres.T + np.sqrt((q * q).sum(axis=1))[:, None] * radii[None]
                row, block = np.nonzero(reach >= (least - 1e-9 * (1 + np.where(np.isfinite(least), np.abs(least), 0)))[:, None])
                for i in range(0, len(row), most):
                    some = batch.take(pa.array(row[i : i + most]))
                    yield pa.RecordBatch.from_arrays([*some.columns, pa.array(blocks[block[i : i + most]])], names=["query", "vec", "least", "block"])

    return run


def _checked(size: int, keep: int, rows: int = 256):
    def run(key, queries: pd.DataFrame, points: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"query": np.empty(0, np.int64), "point": np.empty(0, np.int64), "score": np.empty(0)})
        if not len(queries) or not len(points):
            return empty
        points = points.sort_values("place")
        q, x = _matrix(list(queries["vec"]), size), _matrix(list(points["vec"]), size)
        least, names, ids = queries["least"].to_numpy(), queries["query"].to_numpy(), points["point"].to_numpy()
        slack = 1e-9 * (1 + np.where(np.isfinite(least), np.abs(least), 0))
        length = np.sqrt((q * q).sum(axis=1))
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for at in range(0, len(x), rows):
            part = x[at : at + rows]
            centre = part.mean(axis=0)
            radius = float(np.sqrt(((part - centre) ** 2).sum(axis=1).max()))
            may = np.flatnonzero(q @ centre + length * radius >= least - slack)
            if len(may):
                a, b = np.nonzero(q[may] @ part.T >= (least - slack)[may, None])
                found.append((may[a], b + at))
        if not found:
            return empty
        a, b = (np.concatenate(c) for c in zip(*found))
        out = [exact_scores(q[a[i : i + (1 << 16)]], x[b[i : i + (1 << 16)]]) for i in range(0, len(a), 1 << 16)]
        frame = pd.DataFrame({"query": names[a], "point": ids[b], "score": np.concatenate([np.empty(0), *out])})
        frame = frame.sort_values(["query", "score", "point"], ascending=[True, False, True])
        return frame.groupby("query", sort=False).head(keep)

    return run


def _check(points: DataFrame, ranked: DataFrame, best: DataFrame, size: int, keep: int) -> DataFrame:
    """Points that reach the score of each query's last neighbour, from the blocks that may hold any.

    The table of balls has one row for `POINT_BLOCK` points and goes to every worker: 13 MB for
    10^8 vectors of 64 dimensions. Pairs of a query and a block are made from it, then queries in
    groups meet blocks, so a task holds at most `POINT_BLOCK` points and about `QUERY_BLOCK` queries.
    """
    blocked = cut(ranked.where("curve = 0 and own and not query").select("point", "place", F.floor(F.col("place") / POINT_BLOCK).cast("long").alias("block")).join(points.select("point", "vec"), "point"))
    balls = blocked.groupBy("block").applyInArrow(_ball(size), "block long, centre binary, radius double").orderBy("block").collect()
    blocks, radii = np.array([r["block"] for r in balls], dtype=np.int64), np.array([r["radius"] for r in balls])
    centres = _matrix([bytes(r["centre"]) for r in balls], size)
    last = best.groupBy("query").agg(F.when(F.count("*") >= keep, F.min("score")).otherwise(F.lit(float("-inf"))).alias("least"))
    asked = points.where("asks").select(F.col("point").alias("query"), "vec").join(last, "query", "left").select("query", "vec", F.coalesce("least", F.lit(float("-inf"))).alias("least"))
    groups = max(1, -(-points.where("asks").count() // QUERY_BLOCK))
    queries = cut(asked.mapInArrow(_pairs(size, blocks, centres, radii), "query long, vec binary, least double, block long").withColumn("group", F.pmod(F.xxhash64("query"), F.lit(groups)).cast("int")))
    met = blocked.join(queries.select("block", F.col("group").alias("_group")).distinct().withColumnRenamed("_group", "group"), "block")
    return queries.groupBy("group", "block").cogroup(met.groupBy("group", "block")).applyInPandas(_checked(size, keep), "query long, point long, score double")


# ---- the search -----------------------------------------------------------------------------


def neighbours(vectors: DataFrame, is_query, k: int = NEIGHBOURS, check: bool = True, curves: int = CURVES, window: int = WINDOW, chunk: int = CHUNK, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest rows of each row that `is_query`
    (a Column over `vectors`) marks, by largest inner product in double precision, ties to smaller ids.

    Vectors that are null, zero, or hold null or non-finite components take no part, nor do
    vectors of another length than most (no inner product is defined). Rows that repeat an id and
    a vector count once; a query never finds its own id. Fewer candidates give fewer rows, an
    empty table none. Lists do not depend on the number of partitions.
    """
    spark = vectors.sparkSession
    kind = np.float32 if dict(vectors.dtypes)[vec_col] == "array<float>" else np.float64
    named = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("embedding"), F.coalesce(is_query, F.lit(False)).alias("is_query"))
    asking = named.where("is_query and vec_id is not null").select("vec_id").distinct().withColumn("is_query", F.lit(True))
    rows = cut(named.select("vec_id", "embedding").mapInArrow(_packed(kind), "vec_id long, size int, norm double, vec binary").join(asking, "vec_id", "left").withColumn("is_query", F.coalesce("is_query", F.lit(False))))
    common = rows.groupBy("size").agg(F.count("*").alias("n"), F.max("norm").alias("longest")).orderBy(F.desc("n"), "size").first()
    schema = "query_id long, rank int, vec_id long, score double"
    if common is None:
        return spark.createDataFrame([], schema)
    size, keep, parts = int(common["size"]), k + 1, shuffle_partitions(spark)
    rows = rows.where(F.col("size") == size)
    #: Per vector, its least k + 1 ids: repeated rows go first, each pair by itself, and ids are
    #: limited before the shuffle by vector, so neither repeats nor copies gather.
    limited = rows.select("vec", "vec_id").distinct().withColumn("_n", F.row_number().over(Window.partitionBy("vec").orderBy("vec_id"))).where(F.col("_n") <= keep)
    folded = limited.groupBy("vec").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    asked = rows.where("is_query").select("vec").distinct().withColumn("asks", F.lit(True))
    points = cut(folded.join(asked, "vec", "left").select(F.col("ids")[0].alias("point"), "vec", "ids", F.coalesce("asks", F.lit(False)).alias("asks")))
    sample = least_by_hash(points.select("vec", "point"), "point", SAMPLE).collect()  # at most SAMPLE rows
    grid = Curves(_matrix([bytes(r["vec"]) for r in sample], size), float(common["longest"]), curves)
    keys = points.select("point", "vec", "asks").mapInArrow(_keyed(grid, size), "curve int, key long, point long, query boolean")
    ordered = cut(keys.repartitionByRange(parts, "curve", "key", "point").sortWithinPartitions("curve", "key", "point", "query").select("curve", "point", "query", F.spark_partition_id().alias("part")))
    before, total = {}, dict.fromkeys(range(curves), 0)
    for r in ordered.groupBy("part", "curve").agg(F.count_if(~F.col("query")).alias("n")).orderBy("part", "curve").collect():  # a row a partition and curve
        before[r["part"], r["curve"]] = total[r["curve"]]
        total[r["curve"]] += r["n"]
    ranked = cut(ordered.mapInArrow(_placed(before, window, chunk), "curve int, chunk long, place long, point long, query boolean, own boolean"))
    met = ranked.drop("own").join(points.select("point", "vec"), "point")
    best = cut(_best(met.groupBy("curve", "chunk").applyInArrow(_windowed(size, keep, window), "query long, point long, score double"), keep))
    if check:
        best = _best(best.unionByName(_check(points, ranked, best, size, keep)), keep)
    listed = best.join(points.select("point", "ids"), "point").select("query", "score", F.explode("ids").alias("vec_id"))
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    top = listed.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= keep).groupBy("query").agg(F.array_sort(F.collect_list(F.struct("_n", "vec_id", "score"))).alias("top"))
    names = points.where("asks").select("vec", F.col("point").alias("query"))
    queries = cut(rows.where("is_query").select(F.col("vec_id").alias("query_id"), "vec").distinct().join(names, "vec").select("query_id", "query"))
    # Many ids may ask with one vector.
    lists = cut(queries.groupBy("query").agg(F.count("*").alias("w")).join(top, "query"))
    found = join_by_key(queries, lists, ["query"], "w", queries.count()).select("query_id", F.filter("top", lambda t: t["vec_id"] != F.col("query_id")).alias("top"))
    return found.select("query_id", F.posexplode(F.slice("top", 1, k)).alias("at", "t")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("t.vec_id").alias("vec_id"), F.col("t.score").alias("score"))


#: DuckDB SQL for the registered query; scores add up in the order of `exact_scores`.
ORACLE = """
with v as (select distinct vec_id, list_transform(embedding, lambda x: cast(x as double)) as e from embeddings
  where vec_id is not null and embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
  and len(list_filter(embedding, lambda x: x <> 0)) > 0),
s as (select q.vec_id as query_id, p.vec_id as vec_id, list_reduce(list_transform(range(1, len(p.e) + 1), lambda i: q.e[i] * p.e[i]), lambda a, b: a + b, cast(0 as double)) as score
  from v q, v p where q.vec_id % 20 = 0 and p.vec_id <> q.vec_id and len(p.e) = len(q.e)),
r as (select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank, vec_id, score from s)
select * from r where rank <= 20
"""
