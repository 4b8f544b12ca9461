"""Toxic passages by maximum-scoring segments of token log-odds.

Learning. In a bounded sample of labelled documents, the documents of either label that hold a
node are counted, where a word's nodes are the word and its beginnings of two to six letters (so
an unseen form of a known stem is known). A node's log-odds between the labels are smoothed by a
Dirichlet prior in proportion to the node's share of all documents plus a half. A node scores
its log-odds less one standard deviation if they are at least `Z` standard deviations above zero
and it mostly stands in toxic documents (a beginning: nearly always). The longest scoring node of
a word counts, and every other word scores `DRIFT`.

Search. One linear scan finds all maximal scoring segments of a text (each is a passage whose
score no extension or trimming raises). With the scores' distribution in clean text, the number
of clean segments of a text of n words that reach S is expected to be E = K n exp(-lambda S);
lambda solves the usual moment equation, and K follows from how many segments of the sample's clean
texts reach a score in the middle of theirs. A passage with E of at most `EXPECT` is significant,
and the text's statistic is the sum of -ln E over significant passages. A logistic curve fitted
on the sample turns the statistic into a probability.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm.common import cut, held_out
from siftwell.llm.labelled import SAMPLE_ROWS, labelled_sample
from siftwell.llm.rewrite import keep_rows

DRIFT = -0.6
TOP = 6.0
PRIOR = 5.0
#: Least standard deviations above zero, and documents, of a scoring node.
Z, LEAST_DOCUMENTS = 2.8, 4
#: Least share of toxic documents among those that hold a scoring word, and a scoring beginning.
WORD_SHARE, STEM_SHARE = 0.5, 0.95
STEM = range(2, 7)
EXPECT = 0.5
THRESHOLD = 0.7
#: Steps of the histogram of clean segments, and what K is before any is seen.
STEP, FIRST_K = 0.25, 0.1
#: Chunks of which a worker remembers the score, for one task.
MEMORY = 1 << 16
_WORD = re.compile(r"\w+")
_CHUNK = re.compile(r"\S+")


def nodes_of(word: str) -> list[str]:
    """The word (marked as whole) and its beginnings."""
    return [f"{word} ", *(word[:n] for n in STEM if n < len(word) + 1)]


def _count_nodes(batches: Iterator[pa.RecordBatch], most: int = 1 << 17) -> Iterator[pa.RecordBatch]:
    """(label, text) to (node, clean, toxic): documents that hold the node, in parts that add up."""
    counts: tuple[Counter, Counter] = (Counter(), Counter())

    def out() -> pa.RecordBatch:
        names = list(counts[0].keys() | counts[1].keys())
        columns = [pa.array(names, pa.string()), *(pa.array([c[w] for w in names], pa.int64()) for c in counts)]
        for c in counts:
            c.clear()
        return pa.RecordBatch.from_arrays(columns, names=["node", "clean", "toxic"])

    for batch in batches:
        for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            counts[label].update({node for word in set(_WORD.findall(text.lower())) for node in nodes_of(word)})
            counts[label][""] += 1
            if len(counts[0]) + len(counts[1]) >= most:
                yield out()
    yield out()


@dataclass(frozen=True)
class Model:
    """Node scores, the extreme-value parameters (lambda is `rate`) and the logistic curve."""

    scores: dict[str, float]
    rate: float
    slope: float
    base: float
    k: float = FIRST_K

    def probability(self, statistic: float) -> float:
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, self.base + self.slope * statistic))))


class Scores(dict):
    """Score of a blank-separated chunk of lower-case text: of its highest word."""

    def __init__(self, scores: dict[str, float]):
        self.scores = scores

    def __missing__(self, chunk: str) -> float:
        best = DRIFT
        for word in _WORD.findall(chunk):
            for node in (f"{word} ", *(word[:n] for n in reversed(STEM) if n <= len(word))):
                if (s := self.scores.get(node)) is not None:
                    best = max(best, s)
                    break
        self[chunk] = best
        return best

    def limit(self) -> None:
        """Forgets when it holds too much; called between texts."""
        if len(self) > MEMORY:
            self.clear()


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end exclusive, score), left to right, in linear time."""
    sums = np.concatenate([[0.0], np.cumsum(scores)])
    found: list[tuple[float, float, int, int, int]] = []  # left sum, right sum, start, end, nearest lower to the left
    for i in np.flatnonzero(scores > 0).tolist():
        left, right, start = float(sums[i]), float(sums[i + 1]), i
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][0] >= left:
                j = found[j][4]
            if j < 0 or found[j][1] >= right:
                found.append((left, right, start, i + 1, j))
                break
            left, start = found[j][0], found[j][2]
            del found[j:]
    return [(start, end, right - left) for left, right, start, end, _ in found]


def passages(text: str | None, model: Model, memo: Scores) -> tuple[float, list[tuple[int, int, float]]]:
    """The statistic of a whole text and its significant passages (start, end, -ln E) in characters."""
    chunks = (text or "").lower().split()
    memo.limit()
    scores = np.fromiter(map(memo.__getitem__, chunks), dtype=np.float64, count=len(chunks))
    if not len(scores) or scores.max() <= 0:
        return 0.0, []
    log_kn = math.log(max(model.k * len(scores), 1.0))
    found = [(a, b, model.rate * s - log_kn) for a, b, s in segments(scores)]
    found = [x for x in found if -x[2] <= math.log(EXPECT)]
    if not found:
        return 0.0, []
    spans = [m.span() for m in _CHUNK.finditer(text)]
    if len(spans) != len(chunks):  # lower-casing made blanks; place by share
        spans = [(0, len(text))] * len(chunks)
    return sum(x[2] for x in found), [(spans[a][0], spans[b - 1][1], v) for a, b, v in found]


def _rate(share: float, score: float) -> float:
    """The positive root of share exp(r score) + (1 - share) exp(r DRIFT) = 1."""
    low, high = 1e-6, 20.0
    value = lambda r: share * math.exp(r * score) + (1 - share) * math.exp(r * DRIFT) - 1
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (low, middle) if value(middle) > 0 else (middle, high)
    return high


def _clean_rate(steps: dict[int, float], words: float, rate: float) -> float:
    """K, from the number of clean segments that reach the middle of their scores, with a weak prior
    of one segment at `FIRST_K`; at least a thousandth of that."""
    total = sum(steps.values())
    seen, middle = 0.0, 0
    for middle in sorted(steps):
        seen += steps[middle]
        if 2 * seen >= total:
            break
    reach = sum(n for step, n in steps.items() if step >= middle)
    return max(FIRST_K / 1000, min(10.0, (reach + 1.0) / (words * math.exp(-rate * middle * STEP) + 1.0 / FIRST_K)))


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and base by a few Newton steps with a weak prior, slope at least 0."""
    w, b = 0.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(w * x + b, -30, 30)))
        g, h = p - y, np.maximum(p * (1 - p), 1e-6)
        hww, hwb, hbb = (h * x * x).sum() + 0.5, (h * x).sum(), h.sum() + 0.05
        gw, gb = (g * x).sum() + 0.5 * w, g.sum() + 0.05 * b
        det = max(hww * hbb - hwb * hwb, 1e-12)
        dw, db = (hbb * gw - hwb * gb) / det, (hww * gb - hwb * gw) / det
        w, b = w - max(-2, min(2, dw)), b - max(-2, min(2, db))
    return max(w, 0.0), b


def learn(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    """Fits on at most `rows` labelled, not held-out documents. Without both labels no word scores
    and every text has the same score, at most a half."""
    sample = labelled_sample(docs, labels, "toxic", rows)
    counted = cut(sample.select("label", "text").mapInArrow(_count_nodes, "node string, clean long, toxic long").groupBy("node").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")))
    sizes = {r["node"]: r for r in counted.where("node = ''").collect()}.get("")
    if sizes is None or not sizes["clean"] or not sizes["toxic"]:
        # Labels of one kind tell nothing apart: no text is called toxic for that.
        return Model({}, 1.0, 0.0, min(0.0, math.log((sizes["toxic"] + 0.5) / (sizes["clean"] + 0.5))) if sizes else 0.0)
    n0, n1 = float(sizes["clean"]), float(sizes["toxic"])
    both = F.col("clean") + F.col("toxic")
    prior = PRIOR * (F.col("clean") + F.col("toxic")) / (n0 + n1) + 0.5
    a1, a0 = F.col("toxic") + prior, F.col("clean") + prior
    odds = F.log(a1 / n1) - F.log(a0 / n0)
    share = F.col("toxic") / (F.col("clean") + F.col("toxic"))
    picked = counted.where(F.col("toxic") >= LEAST_DOCUMENTS).where(share >= F.when(F.col("node").endswith(" "), WORD_SHARE).otherwise(STEM_SHARE))
    picked = picked.where("node <> ''").select("node", odds.alias("odds"), F.sqrt(1 / a1 + 1 / a0).alias("deviation")).where(F.col("odds") >= Z * F.col("deviation"))
    # Tokens of the bounded sample, so bounded; only its scoring nodes come to the driver.
    scores = {r["node"]: min(TOP, float(r["odds"] - r["deviation"])) for r in picked.collect()}

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What clean texts hold: number and sum by name, where a name is `word`, `hit` or a step of segment scores."""
        memo, found = Scores(scores), Counter()
        for batch in batches:
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if label == 0:
                    v = np.fromiter(map(memo.__getitem__, text.lower().split()), dtype=np.float64)
                    found["word"] += len(v)
                    found["hit"] += int((v > 0).sum())
                    found["score"] += float(v[v > 0].sum())
                    found.update(f"{int(s / STEP)}" for *_, s in segments(v))
                    memo.limit()
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array([float(x) for x in found.values()], pa.float64())], names=["name", "value"])

    # One row a step of scores, however many texts there are.
    clean = {r["name"]: float(r["value"]) for r in sample.select("label", "text").mapInArrow(measure, "name string, value double").groupBy("name").agg(F.sum("value").alias("value")).collect()}
    words, hits, score = (clean.pop(name, 0.0) for name in ("word", "hit", "score"))
    mean = (score + 3.0) / (hits + 1)
    rate = min(3.0, _rate(min(0.2, (hits + 1) / (words + 1)), mean))
    model = Model(scores, rate, 1.0, 0.0, _clean_rate({int(step): n for step, n in clean.items()}, words, rate))

    def statistic(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Scores(scores)
        for batch in batches:
            values = [passages(t, model, memo)[0] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.float64())], names=["label", "value"])

    seen = sample.select("label", "text").mapInArrow(statistic, "label int, value double").collect()  # at most `rows` pairs of numbers
    x, y = np.array([r["value"] for r in seen]), np.array([r["label"] for r in seen], dtype=np.float64)
    slope, base = _logistic(np.minimum(x, 20.0) / 20.0, y)
    return Model(scores, model.rate, slope / 20.0, base, model.k)


def score(docs: DataFrame, model: Model, with_passages: bool = False) -> DataFrame:
    """doc_id, score and, on demand, passages (array of start, end, weight in characters), for every
    row. Null and empty texts have no passage and the lowest score; repeated rows give repeated rows."""
    kind = "array<struct<start: int, stop: int, weight: double>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Scores(model.scores)
        for batch in batches:
            got = [passages(t.as_py(), model, memo) for t in batch.column(1)]
            arrays = [batch.column(0), pa.array([model.probability(min(x, 20.0)) for x, _ in got], pa.float64())]
            if with_passages:
                arrays.append(pa.array([[{"start": a, "stop": b, "weight": v} for a, b, v in p] for _, p in got], pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("weight", pa.float64())]))))
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "score", "passages"][: len(arrays)])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double" + f", passages {kind}" * with_passages)


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    scored = score(docs, learn(docs, labels, rows))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of `docs`, with all columns, that `toxicity` does not reject. Null texts stay."""
    model = learn(docs, labels, rows)
    memo = Scores(model.scores)
    return keep_rows(docs, lambda texts: [model.probability(min(passages(t, model, memo)[0], 20.0)) < threshold for t in texts])
