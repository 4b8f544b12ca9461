"""Packing of token sequences by vector best fit over a histogram of piece lengths.

Pieces of one length are interchangeable, so the bins are chosen on the histogram of lengths: at
most `capacity` entries however many documents there are. Lengths are taken from long to short.
Each class of equal bins (a multiset of lengths with a count) has three residual capacities:
tokens, documents and attention cost (the sum of squared lengths). Among the classes that can
take the next length under every constraint, the one with the least weighted norm of what would
remain is chosen (`rule="norm"`), or the one with the largest weighted dot product of demand and
residual (`rule="dot"`). A class takes as many of the length as it has bins, so the number of
steps follows the number of different lengths and classes, not the number of documents.

Every piece is then numbered within its length (numbers start from counts of salted groups, so a
length that a third of all rows have is not numbered in one task) and takes the place that the
plan has for that number.
"""

from __future__ import annotations

import base64
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftwell.llm.common import cut, shuffle_partitions

CAPACITY = 1024
END = 2
#: A worker remembers the ids of the last so many different chunks, twice over, for one task.
MEMORY = 1 << 16
#: Longest chunk that is remembered, in characters; with `MEMORY` it bounds what a worker holds.
REMEMBERED = 32


@lru_cache(maxsize=8)
def ranks_of(tokenizer: str) -> tuple[str, str] | None:
    """Where the vocabulary of a byte-level BPE file lies beside it as ranks, and both libraries agree
    on a probe: the path of the ranks and their pattern. Ranks are several times as fast. The driver
    asks once, so that a worker loads one library only."""
    import public_tokenizers
    from tokenizers import Tokenizer

    ranks = Path(tokenizer).with_suffix(".tiktoken")
    if not ranks.exists():
        return None
    model = Tokenizer.from_file(tokenizer)
    model.encode_special_tokens = True
    quick, word = _by_ranks(str(ranks), public_tokenizers.PATTERN)
    plain = lambda text: array("I", model.encode(text, add_special_tokens=False).ids).tobytes()
    probe = "It's 12 cafés,  naïve\n\n tabs\t日本 <|endoftext|> don't\r\n"
    same = quick(probe) == plain(probe) and word("naïve") == plain(" naïve")
    return (str(ranks), public_tokenizers.PATTERN) if same else None


def _by_ranks(ranks: str, pattern: str):
    """Two functions to ids as bytes: of any text, and of a space and letters alone."""
    import tiktoken

    with open(ranks, "rb") as lines:
        vocabulary = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    own = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=vocabulary, special_tokens={})
    merge = own._core_bpe.encode_single_piece
    return (lambda text: array("I", own.encode_ordinary(text)).tobytes()), (lambda letters: array("I", merge(f" {letters}".encode())).tobytes())


def _by_file(tokenizer: str):
    """The same by the `tokenizers` library."""
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(tokenizer)
    model.encode_special_tokens = True  # their strings in a text are ordinary text
    plain = lambda text: array("I", model.encode(text, add_special_tokens=False).ids).tobytes()
    return plain, (lambda word: plain(f" {word}"))


class Encoder:
    """From text to the bytes of its ids (unsigned, 32 bits, little-endian).

    Pre-tokens never span a space that stands alone before the next character, so a text without
    double spaces is the concatenation of its chunks cut before each space. Chunks are remembered
    for speed alone, in two generations of at most `MEMORY`, until `forget`.
    """

    def __init__(self, tokenizer: str, ranks: tuple[str, str] | None):
        self.text, self.word = _by_ranks(*ranks) if ranks else _by_file(tokenizer)
        self.forget()

    def forget(self) -> None:
        self.recent: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def __call__(self, text: str) -> bytes:
        if not text:
            return b""
        if "  " in text:
            return self.text(text)
        first, *rest = text.split(" ")
        out = [self.text(first)] if first else []
        get, put = self.recent.get, out.append
        for chunk in rest:
            ids = get(chunk)
            if ids is None:
                ids = self.older.get(chunk)
                if ids is None:
                    ids = self.word(chunk) if chunk.isalpha() else self.text(f" {chunk}")
                if len(chunk) <= REMEMBERED:
                    self.recent[chunk] = ids
                    if len(self.recent) >= MEMORY:
                        self.recent, self.older = {}, self.recent
                        get = self.recent.get
            put(ids)
        return b"".join(out)


@lru_cache(maxsize=1)
def _encoder(tokenizer: str, ranks: tuple[str, str] | None) -> Encoder:
    """A worker's encoder: the vocabulary is loaded once, what it remembers goes after each task."""
    return Encoder(tokenizer, ranks)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END, with_ids: bool = True) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, on demand, ids: the pieces of every row.

    A document is its token ids followed by `end`; null counts as empty. Documents of more than
    `capacity` ids are cut; the first piece takes what is over, all others are full.
    """
    schema = "doc_id long, piece int, start long, length int, ids_crc32 long" + ", ids array<int>" * with_ids
    tail = np.asarray([end], dtype="<u4").tobytes()
    ranks = ranks_of(tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(tokenizer, ranks)
        for batch in batches:
            rows: list[tuple] = []
            flat: list[bytes] = []
            held = 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encode(text.as_py() or "") + tail
                n = len(ids) // 4
                at, piece, size = 0, 0, n % capacity or min(n, capacity)
                while at < n:
                    part = ids[4 * at : 4 * (at + size)]
                    rows.append((doc_id, piece, at, size, zlib.crc32(part)))
                    if with_ids:
                        flat.append(part)
                    at, piece, size = at + size, piece + 1, capacity
                held += len(ids) if with_ids else 0
                if held >= 1 << 24 or len(rows) >= 1 << 14:
                    yield _pieces(rows, flat, with_ids)
                    rows, flat, held = [], [], 0
            if rows:
                yield _pieces(rows, flat, with_ids)
        encode.forget()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def _pieces(rows: list[tuple], flat: list[bytes], with_ids: bool) -> pa.RecordBatch:
    columns = list(zip(*rows))
    arrays = [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64()))]
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    if with_ids:
        ends = np.concatenate([[0], np.cumsum([len(x) // 4 for x in flat])]).astype(np.int32)
        arrays.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(flat), dtype="<u4").astype(np.int32))))
        names.append("ids")
    return pa.RecordBatch.from_arrays(arrays, names=names)


@dataclass(frozen=True)
class Limits:
    """What a sequence may hold, and the weight of each dimension in the choice of bins."""

    tokens: int = CAPACITY
    documents: int = CAPACITY
    attention: int = CAPACITY * CAPACITY
    weights: tuple[float, float, float] = (1.0, 0.05, 0.2)
    rule: str = "norm"


@dataclass
class Plan:
    """Where the pieces of each length go. Row i holds for numbers `first` to `last` (exclusive)
    of its length: `per` of them in each sequence from `sequence` on, at `offset`."""

    length: np.ndarray
    first: np.ndarray
    last: np.ndarray
    per: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    sequences: int


def plan(histogram: dict[int, int], limits: Limits = Limits()) -> Plan:
    """Vector best fit, long to short, over classes of equal bins."""
    caps = np.array([limits.tokens, limits.documents, limits.attention], dtype=np.float64)
    weights = np.asarray(limits.weights)
    residual, count, contents = np.empty((64, 3)), np.zeros(64, dtype=np.int64), []  # type: ignore[var-annotated]
    known: dict[tuple, int] = {}

    def add(left: np.ndarray, n: int, inside: tuple[tuple[int, int], ...]) -> None:
        nonlocal residual, count
        if (k := known.get(inside)) is None:
            k = known[inside] = len(contents)
            contents.append(inside)
            if k == len(count):
                residual, count = np.resize(residual, (2 * k, 3)), np.concatenate([count, np.zeros(k, dtype=np.int64)])
                count[k:] = 0
            residual[k] = left
        count[k] += n

    for size in sorted(histogram, reverse=True):
        demand = np.array([size, 1, size * size], dtype=np.float64)
        if (demand > caps).any():
            raise ValueError(f"a piece of {size} tokens fits no sequence")
        left = histogram[size]
        while left:
            m = len(contents)
            after = residual[:m] - demand
            fits = np.flatnonzero((count[:m] > 0) & (after >= 0).all(axis=1))
            if not len(fits):
                # As many as fit one empty bin go together, so a hot length takes two steps.
                each = int(min(left, (caps // demand).min()))
                bins = left // each
                add(caps - each * demand, bins, ((size, each),))
                left -= bins * each
                continue
            if limits.rule == "dot":
                cost = -((residual[fits] / caps) * (demand / caps) * weights).sum(axis=1)
            else:
                cost = (((after[fits] / caps) ** 2) * weights).sum(axis=1)
            k = int(fits[np.argmin(cost)])
            each = int(min((residual[k] // demand).min(), max(1, left // count[k])))
            bins = int(min(count[k], left // each))
            inside = contents[k]
            inside = inside[:-1] + ((size, inside[-1][1] + each),) if inside[-1][0] == size else inside + ((size, each),)
            count[k] -= bins
            add(residual[k] - each * demand, bins, inside)
            left -= bins * each

    rows, given, sequence = [], dict.fromkeys(histogram, 0), 0
    for k, inside in enumerate(contents):
        if bins := int(count[k]):
            at = 0
            for size, each in inside:
                rows.append((size, given[size], given[size] + bins * each, each, sequence, at))
                given[size] += bins * each
                at += size * each
            sequence += bins
    table = np.array(sorted(rows), dtype=np.int64).reshape(-1, 6)
    return Plan(*table.T, sequences=sequence)


def place(of: Plan, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of the pieces with these lengths and numbers within their length."""
    if not len(length):
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    widest = int(of.last.max()) + 1
    row = np.searchsorted(of.length * widest + of.first, length.astype(np.int64) * widest + number, side="right") - 1
    inside = number - of.first[row]
    return of.sequence[row] + inside // of.per[row], of.offset[row] + (inside % of.per[row]) * of.length[row]


def pack(pieces: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """`pieces` (doc_id, piece, length and any other columns) with sequence_id and offset.

    Sequences are gapless from offset 0 and hold every piece once. Ties and repeated rows are
    packed like any other; an empty table gives no rows. `length` must be from 1 to the limit.
    """
    spark = pieces.sparkSession
    salts = max(16, shuffle_partitions(spark))
    kept = cut(pieces.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)).cast("int")))
    counts = cut(kept.groupBy("length", "_salt").count())
    histogram = {int(r[0]): int(r[1]) for r in counts.groupBy("length").agg(F.sum("count")).collect()}  # at most `tokens` rows
    chosen = plan(histogram, limits) if histogram else None
    before = counts.withColumn("_before", F.sum("count").over(Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1))).select("length", "_salt", F.coalesce("_before", F.lit(0)).alias("_before"))
    inside = Window.partitionBy("length", "_salt").orderBy("doc_id", "piece")
    numbered = kept.withColumn("_in", F.row_number().over(inside) - 1).join(before, ["length", "_salt"]).withColumn("_number", F.col("_before") + F.col("_in"))

    @F.pandas_udf("struct<sequence_id: long, offset: long>")
    def where(length: pd.Series, number: pd.Series) -> pd.DataFrame:
        sequence, offset = place(chosen, length.to_numpy(), number.to_numpy())
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    placed = numbered.withColumn("_at", where("length", "_number"))
    return placed.select(*[c for c in pieces.columns], "_at.sequence_id", "_at.offset")


def pack_documents(docs: DataFrame, tokenizer: str | None = None, limits: Limits = Limits(), with_ids: bool = True) -> DataFrame:
    """All documents as packed pieces: doc_id, piece, start, length, ids_crc32, sequence_id,
    offset and, on demand, ids. Null and empty texts are one piece with the end id alone."""
    pieces = token_pieces(docs, tokenizer or default_tokenizer(), limits.tokens, with_ids=with_ids)
    packed = pack(pieces, limits)
    return packed.select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "sequence_id", "offset", *["ids"] * with_ids)
