"""SimHash fingerprints and near-duplicate groups by multi-index hashing.

Fingerprint. Words are maximal runs of bytes other than space and 0x09-0x0D after A-Z became
a-z; a shingle is three consecutive words joined by one space (fewer words: all of them; none:
no shingle and fingerprint zero). Repeated shingles count each time. A bit is set if it is set
in more than half of the shingles' XXH64 values (seed 42).

Links. Two fingerprints link when at most two of their 64 bits differ. The 64 bits are cut
into two halves. At a distance of two or less, one of three things holds: the high halves are
equal, the low halves are equal, or each half differs in exactly one bit. So each distinct
fingerprint is filed once under its high half and once under its low half, and the ball of
radius one round its high half is enumerated to fetch the third kind. In that third case the
parity of the high half changes, so only fingerprints with an even high half enumerate and
those with an odd one are found. Every fetched pair is verified on all 64 bits.

Skew. Copies share a fingerprint and are folded before anything is filed. A half that more
than `bucket` distinct fingerprints share is never gathered: each of its fingerprints
enumerates the remaining ball and looks up full fingerprints, which are unique keys. Within a
bucket the verified links are reduced to a spanning forest before they leave the task, so what
is shuffled on stays linear in the documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from siftwell.llm.common import FOLD, HOT_SHARE, cut, join_by_key, shuffle_partitions
from siftwell.llm.components import connected_components, forest, thinned

SEED = 42
RADIUS = 2
#: Most distinct fingerprints of one half that a task compares in memory (in blocks of numpy).
BUCKET = 16384

#: For a byte value, its eight bits, lowest first.
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_PLACES = (np.arange(8, dtype=np.int64) * 256)[None, :]


def fingerprint(text: str | None) -> int:
    """The fingerprint of one text; null counts as a text without words."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(FOLD).split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) < 3:
        return xxhash.xxh64_intdigest(joined, SEED)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[:-2].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter(
        (digest(joined[a:b], SEED) for a, b in zip(starts, ends[2:].tolist())), dtype=np.uint64, count=len(starts)
    )
    octets = hashes.astype("<u8", copy=False).view(np.uint8).reshape(-1, 8)
    counts = np.bincount((octets + _PLACES).ravel(), minlength=2048).reshape(8, 256) @ _BITS
    bits = (2 * counts.ravel() > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`doc_id`, `fp` (the 64 bits as a signed long) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(t.as_py()) for t in batch.column(1)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        run, "doc_id long, fp long"
    )


def _links_in_bucket(fps: np.ndarray, others: np.ndarray, radius: int, block: int = 2048) -> np.ndarray:
    """Pairs (value, value) of the two sets that differ in 1 to `radius` bits, forest only."""
    found = []
    same = others is fps
    for i in range(0, len(fps), block):
        left = fps[i : i + block]
        for j in range(i if same else 0, len(others), block):
            near = np.bitwise_count(left[:, None] ^ others[None, j : j + block]) <= radius
            a, b = np.nonzero(near)
            if len(a):
                pair = np.stack([left[a], others[j : j + block][b]], axis=1)
                pair = pair[pair[:, 0] != pair[:, 1]]
                if len(pair):
                    found.append(forest(pair))
        if len(found) > 64:
            found = [forest(np.concatenate(found))]
    return forest(np.concatenate(found)) if found else np.empty((0, 2), dtype=fps.dtype)


def _bucket_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (half, key, fp, probe), sorted by half and key, to verified links.

    Members with `probe` false are filed under the key. Probes come from one bit away in the
    high half, so they may differ in one further bit.
    """
    rest: tuple[np.ndarray, ...] | None = None

    def close(half, key, fp, probe):
        cuts = np.flatnonzero((key[1:] != key[:-1]) | (half[1:] != half[:-1])) + 1
        bounds = np.concatenate([[0], cuts, [len(key)]])
        sizes = np.diff(bounds)
        out = []
        for k in np.flatnonzero(sizes > 1):
            a, b = bounds[k], bounds[k + 1]
            members = fp[a:b][~probe[a:b]]
            probes = fp[a:b][probe[a:b]]
            if len(members) > 1:
                out.append(_links_in_bucket(members, members, RADIUS))
            if len(members) and len(probes):
                out.append(_links_in_bucket(probes, members, RADIUS))
        pairs = np.concatenate(out) if out else np.empty((0, 2), dtype=np.uint64)
        return pa.RecordBatch.from_arrays(
            [pa.array(pairs[:, 0].copy().view(np.int64)), pa.array(pairs[:, 1].copy().view(np.int64))], names=["a", "b"]
        )

    for batch in batches:
        if not batch.num_rows:
            continue
        part = (
            batch.column(0).to_numpy(zero_copy_only=False),
            batch.column(1).to_numpy(zero_copy_only=False),
            batch.column(2).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64),
            batch.column(3).to_numpy(zero_copy_only=False).astype(bool),
        )
        part = part if rest is None else tuple(np.concatenate(x) for x in zip(rest, part))
        last = len(part[1]) - 1
        open_from = int(np.flatnonzero((part[1] != part[1][last]) | (part[0] != part[0][last]))[-1:].sum() + 1)
        if (part[1][0] == part[1][last]) and (part[0][0] == part[0][last]):
            open_from = 0
        if open_from:
            yield close(*(x[:open_from] for x in part))
        rest = tuple(x[open_from:] for x in part)
    if rest is not None and len(rest[0]):
        yield close(*rest)


def _masks(positions_a: range, positions_b: range | None) -> list[int]:
    """Signed masks with one or two bits of one half, or one bit of each half."""
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    if positions_b is not None:
        return [signed((1 << a) | (1 << b)) for a in positions_a for b in positions_b]
    ones = [1 << a for a in positions_a]
    return [signed(m) for m in ones] + [signed(ones[i] | ones[j]) for i in range(len(ones)) for j in range(i)]


def links(distinct: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(a, b): pairs of the distinct fingerprints of column `fp` that connect exactly what chains of
    links connect. Not every link: each bucket's links become pairs of a member and its root."""
    spark = distinct.sparkSession
    high, low = F.shiftrightunsigned("fp", 32), F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))
    base = distinct.select("fp", high.alias("hi"), low.alias("lo"))
    filed = base.select("fp", F.explode(F.array(F.struct(F.lit(0).alias("half"), F.col("hi").alias("key")), F.struct(F.lit(1).alias("half"), F.col("lo").alias("key")))).alias("x")).select("fp", "x.half", "x.key")
    #: At most twice the documents / bucket keys, and nearly always none.
    hot = cut(filed.groupBy("half", "key").count().where(F.col("count") > bucket).select("half", "key", F.lit(True).alias("hot")))
    any_hot = not hot.isEmpty()
    flips = F.array(*[F.lit(1 << b) for b in range(32)])
    even = F.bit_count("hi") % 2 == 0
    members = filed.withColumn("probe", F.lit(False))
    probes = base.where(even)
    if any_hot:
        members = members.join(hot, ["half", "key"], "left_anti")
        high_hot = hot.where("half = 0").select(F.col("key").alias("hi"))
        probes = probes.join(high_hot, "hi", "left_anti")
    probes = probes.select("fp", F.lit(0).alias("half"), F.explode(F.transform(flips, lambda m: F.col("hi").bitwiseXOR(m))).alias("key"), F.lit(True).alias("probe"))
    if any_hot:
        probes = probes.join(hot, ["half", "key"], "left_anti")
    rows = members.select("half", "key", "fp", "probe").unionByName(probes.select("half", "key", "fp", "probe"))
    parts = shuffle_partitions(spark)
    near = rows.repartition(parts, "half", "key").sortWithinPartitions("half", "key").mapInArrow(_bucket_links, "a long, b long")
    if any_hot:
        whole = distinct.select(F.col("fp").alias("b"))

        def by_ball(fps: DataFrame, masks: list[int]) -> DataFrame:
            reach = fps.select(F.col("fp").alias("a"), F.explode(F.transform(F.array(*map(F.lit, masks)), lambda m: F.col("fp").bitwiseXOR(m))).alias("b"))
            return reach.join(whole, "b", "left_semi").select("a", "b")

        in_high = base.join(high_hot, "hi", "left_semi")
        in_low = base.join(hot.where("half = 1").select(F.col("key").alias("lo")), "lo", "left_semi")
        far = by_ball(in_high, _masks(range(32), None) + _masks(range(32), range(32, 64))).unionByName(by_ball(in_low, _masks(range(32, 64), None)))
        near = near.unionByName(thinned(far))
    return near


def _groups(prints: DataFrame, bucket: int) -> DataFrame:
    """fp, least, n (rows), component_id of each distinct fingerprint of `prints` (fp and `key`, any
    type that has an order): `least` is the least key of its rows, component_id of its group's."""
    classes = cut(prints.groupBy("fp").agg(F.min("key").alias("least"), F.count("*").alias("n")))
    components = connected_components(links(classes.select("fp"), bucket), thin=False)  # only fingerprints that link
    named = cut(classes.join(components, components.node == classes.fp).select("fp", "component", "least"))
    groups = cut(named.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("w")))
    linked = join_by_key(named, groups, ["component"], "w", named.count()).select("fp", "component_id")
    return classes.join(linked, "fp", "left").select("fp", "least", "n", F.coalesce("component_id", "least").alias("component_id"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket: int = BUCKET) -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), component_id.

    component_id is the smallest doc_id that a chain of links reaches, the row's own included.
    Null and word-less texts have fingerprint zero and link like any other. Rows with a null id
    keep a null id and take the component of their fingerprint. Repeated ids give repeated rows.
    An empty table gives no rows; other columns are not read.
    """
    prints = cut(fingerprints(docs, id_col, text_col))
    groups = cut(_groups(prints.withColumnRenamed("doc_id", "key"), bucket).select("fp", "n", "component_id"))
    return join_by_key(prints, groups, ["fp"], "n", prints.count()).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _hashable(kind: DataType) -> bool:
    """Spark hashes no maps and no variants."""
    return "map<" not in kind.simpleString() and "variant" not in kind.simpleString()


def drop_near_copies(docs: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """The rows of `docs`, with all columns: of each near-duplicate group exactly one.

    The row with the least doc_id stays, ids before no id; among rows of one id (which may have
    different texts, in one group or in several) the one with the least fingerprint and row hash,
    and one of rows that are equal in every column. So no group ever goes as a whole. Null and
    word-less texts are one group. Columns may have any names. Rows are known by two 64-bit hashes
    of doc_id, text and all other columns; only hashes and ids are grouped, and texts move once,
    to meet the keys that go.
    """
    fields = [F.col(f"`{f.name}`") for f in docs.schema.fields if _hashable(f.dataType)]
    whole = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64(*fields).alias("h1"), F.xxhash64(F.lit(1), *fields).alias("h2"))
    key = ["h1", "h2"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(t.as_py()) for t in batch.column(3)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(prints.view(np.int64))], names=["doc_id", "h1", "h2", "fp"])

    slim = cut(whole.select("doc_id", *key, "text").mapInArrow(run, "doc_id long, h1 long, h2 long, fp long"))
    ranked = slim.select("fp", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "fp", *key).alias("key"))
    stay = _groups(ranked, bucket).where("least = component_id").select("least.h1", "least.h2").distinct()
    counted = cut(slim.groupBy(*key).agg(F.count("*").alias("n")).join(stay.withColumn("stays", F.lit(True)), key, "left"))
    hot = F.col("n") > slim.count() // (HOT_SHARE * shuffle_partitions(docs.sparkSession))
    leave, several = counted.where("stays is null or n > 1"), counted.where("stays and n > 1")
    # Keys of many equal rows are few, so they are broadcast; only rows of the other keys are shuffled.
    rows = whole.select("row", *key)
    single = rows.join(F.broadcast(leave.where(hot).select(*key)), key, "left_anti")
    # Keys that go are as many as rows may be: a merge join at every size, never a broadcast.
    once = single.join(leave.where(~hot).select(*key).hint("merge"), key, "left_anti")
    if several.isEmpty():
        return once.select("row.*")
    repeated = rows.join(F.broadcast(several.where(hot).select(*key)), key, "left_semi").unionByName(single.join(several.where(~hot).select(*key), key, "left_semi"))
    return once.select("row").unionByName(repeated.groupBy(*key).agg(F.any_value("row").alias("row")).select("row")).select("row.*")
