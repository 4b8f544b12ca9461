"""Text quality by a factorisation machine.

Inputs of a text: which of `1 << HASH_BITS` buckets its words hash to (weighted by the root of
their share), structure statistics of the whole text (symbols, capitals, digits, repeated words
and lines, lengths) each cut into quantile cells, and metadata of the caller's choice as hashed
name=value pairs (none by default). The machine scores

    w0 + sum w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)

which weighs every pair of inputs by the product of their factors in time linear in the inputs.
It is fitted by AdaGrad on a bounded sample of labelled rows that are not held out.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm.common import held_out
from siftwell.llm.labelled import labelled_sample

HASH_BITS = 13
FACTORS = 6
CELLS = 8
EPOCHS = 6
SAMPLE = 8_000
#: Words of which a worker remembers the bucket.
MEMORY = 1 << 17
_SYMBOLS = bytes(range(0x21, 0x30)) + bytes(range(0x3A, 0x41)) + bytes(range(0x5B, 0x61)) + bytes(range(0x7B, 0x7F))
_PLAIN = set(b".,;:!?'\"-()")
_ODD = bytes(b for b in _SYMBOLS if b not in _PLAIN)


class Buckets(dict):
    """Bucket of a word, by checksum."""

    def __missing__(self, word: str) -> int:
        self[word] = bucket = zlib.crc32(word.encode("utf-8", "surrogatepass")) & ((1 << HASH_BITS) - 1)
        return bucket


def statistics(text: str, words: list[str], counts: Counter) -> list[float]:
    """Structure of a text; all are defined for the empty text."""
    n, chars = max(len(words), 1), max(len(text), 1)
    raw = text.encode("utf-8", "surrogatepass")
    size = max(len(raw), 1)
    lines = text.split("\n")
    capitals = len(raw) - len(raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    odd = len(raw) - len(raw.translate(None, _ODD))
    symbols = len(raw) - len(raw.translate(None, _SYMBOLS))
    digits = len(raw) - len(raw.translate(None, b"0123456789"))
    twice = sum(a == b for a, b in zip(words, words[1:]))
    alone = sum(not w[0].isalnum() for w in counts if w) / max(len(counts), 1)
    return [
        math.log1p(len(words)),
        len(text) / n,
        capitals / size,
        odd / size,
        symbols / size,
        digits / size,
        len(counts) / n ** 0.9,
        max(counts.values(), default=0) / n,
        twice / n,
        alone,
        len(lines) / n,
        1 - len(set(lines)) / len(lines),
        text.count("!") / chars,
        text.count("|") / chars,
        max(map(len, lines)) / chars,
        sum(map(len, counts)) / max(len(counts), 1),
    ]


def _read(text: str | None, memo: Buckets) -> tuple[list[float], np.ndarray, np.ndarray]:
    """Statistics, and the buckets of the words with their weights."""
    text = text or ""
    words = text.split()
    counts = Counter(words)
    if len(memo) > MEMORY:
        memo.clear()
    buckets = np.fromiter(map(memo.__getitem__, counts), dtype=np.int64, count=len(counts))
    weights = np.sqrt(np.fromiter(counts.values(), dtype=np.float64, count=len(counts)) / max(len(words), 1))
    return statistics(text, words, counts), buckets, weights / max(1.0, math.sqrt((weights**2).sum()) * 2)


def _more(pairs: list[str]) -> np.ndarray:
    return np.array([zlib.crc32(p.encode()) & ((1 << HASH_BITS) - 1) for p in pairs], dtype=np.int64)


@dataclass(frozen=True)
class Machine:
    """Quantile cuts of the statistics, and the weights."""

    cuts: np.ndarray
    w0: float
    w: np.ndarray
    v: np.ndarray

    def inputs(self, stats: list[float], buckets: np.ndarray, weights: np.ndarray, extra: list[str] = ()) -> tuple[np.ndarray, np.ndarray]:
        cells = [(1 << HASH_BITS) + i * CELLS + int(np.searchsorted(c, x, side="right")) for i, (c, x) in enumerate(zip(self.cuts, stats))]
        own = _more(list(extra))
        return np.concatenate([buckets, own, cells]), np.concatenate([weights, np.full(len(own) + len(cells), 0.5)])

    def raw(self, index: np.ndarray, x: np.ndarray) -> float:
        rows = self.v[index] * x[:, None]
        total = rows.sum(axis=0)
        return float(self.w0 + self.w[index] @ x + 0.5 * (total @ total - (rows * rows).sum()))


def _sigmoid(z: float) -> float:
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def fit(rows: list[tuple[int, list[float], np.ndarray, np.ndarray, list[str]]], seed: int = 7, rate: float = 0.1, decay: float = 1e-4) -> Machine:
    """AdaGrad over rows (label, statistics, buckets, weights, metadata); labels 0 and 1 weigh the same."""
    kinds = len(statistics("", [], Counter()))
    size = (1 << HASH_BITS) + CELLS * kinds
    random = np.random.default_rng(seed)
    stats = np.array([r[1] for r in rows], dtype=np.float64).reshape(len(rows), kinds)
    cuts = np.quantile(stats, np.arange(1, CELLS) / CELLS, axis=0).T if len(rows) else np.zeros((kinds, CELLS - 1))
    if len(rows):  # the outer cells also part what stands apart from most rows
        low, high = np.quantile(stats, [0.02, 0.98], axis=0)
        cuts[:, 0], cuts[:, -1] = low, high
        cuts = np.sort(cuts, axis=1)
    ones = sum(r[0] for r in rows)
    base = math.log((ones + 1) / (len(rows) - ones + 1))
    w, v, w0 = np.zeros(size), random.normal(0, 0.03, (size, FACTORS)), base
    machine = Machine(cuts, w0, w, v)
    if not 0 < ones < len(rows):
        return machine
    gw, gv = np.full(size, 1e-2), np.full((size, FACTORS), 1e-2)
    made = [machine.inputs(r[1], r[2], r[3], r[4]) for r in rows]
    weight = {1: len(rows) / (2 * ones), 0: len(rows) / (2 * (len(rows) - ones))}
    for epoch in range(EPOCHS):
        for k in random.permutation(len(rows)):
            index, x = made[k]
            rows_v = v[index] * x[:, None]
            total = rows_v.sum(axis=0)
            z = w0 + w[index] @ x + 0.5 * (total @ total - (rows_v * rows_v).sum())
            y = rows[k][0]
            g = (_sigmoid(z) - y) * min(weight[y], 4.0)
            dw = g * x + decay * w[index]
            dv = g * x[:, None] * (total[None, :] - rows_v) + decay * v[index]
            np.add.at(gw, index, dw * dw)
            np.add.at(gv, index, dv * dv)
            np.subtract.at(w, index, rate * dw / np.sqrt(gw[index]))
            np.subtract.at(v, index, rate * dv / np.sqrt(gv[index]))
            w0 -= 0.01 * g / (1 + epoch)
    return Machine(cuts, w0, w, v)


def learn(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE, metadata: tuple[str, ...] = ()) -> Machine:
    """Fits on at most `rows` labelled, not held-out documents. Their inputs, not their texts, come
    to the driver. Without both labels the machine gives the share of label 1."""
    sample = labelled_sample(docs, labels, "quality", rows)
    if metadata:
        sample = sample.join(docs.select(F.col("doc_id").cast("long").alias("doc_id"), *metadata).dropDuplicates(["doc_id"]), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Buckets()
        for batch in batches:
            got = [_read(t, memo) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([g[0] for g in got], pa.list_(pa.float64())), pa.array([g[1] for g in got], pa.list_(pa.int64())), pa.array([g[2] for g in got], pa.list_(pa.float64())), batch.column(2)], names=["label", "stats", "buckets", "weights", "extra"])

    pairs = F.array(*[F.concat(F.lit(f"{m}="), F.coalesce(F.col(m).cast("string"), F.lit(""))) for m in metadata]) if metadata else F.array().cast("array<string>")
    got = sample.orderBy("doc_id").select("label", "text", pairs.alias("extra")).mapInArrow(run, "label int, stats array<double>, buckets array<long>, weights array<double>, extra array<string>")
    return fit([(r["label"], list(r["stats"]), np.array(r["buckets"], dtype=np.int64), np.array(r["weights"]), list(r["extra"])) for r in got.toLocalIterator()])


def score(docs: DataFrame, machine: Machine, metadata: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, score for every row. Null counts as the empty text; repeated rows give repeated rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Buckets()
        for batch in batches:
            extras = batch.column(2).to_pylist()
            values = [_sigmoid(machine.raw(*machine.inputs(*_read(t.as_py(), memo), extra))) for t, extra in zip(batch.column(1), extras)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.float64())], names=["doc_id", "score"])

    pairs = F.array(*[F.concat(F.lit(f"{m}="), F.coalesce(F.col(m).cast("string"), F.lit(""))) for m in metadata]) if metadata else F.array().cast("array<string>")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), pairs.alias("extra")).mapInArrow(run, "doc_id long, score double")


def quality(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score, predicted for every document; no metadata enters."""
    scored = score(docs, learn(docs, labels, rows))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
