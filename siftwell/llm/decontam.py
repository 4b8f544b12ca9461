"""Benchmark decontamination with one Aho-Corasick automaton over normalised items.

Normal form: A-Z to a-z, words are maximal runs of digits, a-z and characters beyond ASCII, and
the text is its words with one space before and after each. A window is 13 consecutive words of
an item, or all of an item of fewer; windows of all items enter one automaton, each with a space
at either end so that it can only match whole words. A document's normal form is scanned once;
the positions of matches are turned into word numbers, and only for documents with a match into
places of the original text.

The automaton is built from `benchmark`, which is small by nature. Its size is checked. A word
stands in up to 13 windows, so windows take some 13 times the bytes of the items, and a trie 50
times those: beyond `AUTOMATON_BYTES` of windows they are dealt to several automata of that size.
A worker holds the items' words and one automaton at a time: it gathers `SCAN_BYTES` of texts, and
builds, runs and drops one automaton after the other over them. So memory is bounded by these
constants and nothing is left out; a benchmark of many automata costs their building once for
every `SCAN_BYTES` of text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import islice

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm.common import FOLD

WINDOW = 13
#: Most bytes of windows in one automaton (tries take some 50 times as much memory).
AUTOMATON_BYTES = 2_000_000
#: Most bytes of item texts, which every worker holds.
BENCHMARK_BYTES = 32_000_000
#: Bytes of texts that a worker gathers where there are several automata.
SCAN_BYTES = 16_000_000
#: A document is contaminated if at least one word of so many is hit.
HIT_SHARE = 20

#: Bytes that are no part of a word become spaces; A-Z become a-z.
_NORMAL = bytes(0x20 if b <= 0x2F or 0x3A <= b <= 0x40 or 0x5B <= b <= 0x60 or 0x7B <= b <= 0x7F else FOLD[b] for b in range(256))
_ORIGINAL = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def normal(text: str | None) -> list[str]:
    """The words of a text."""
    if not text:
        return []
    return b" ".join(text.encode("utf-8", "surrogatepass").translate(_NORMAL).split()).decode("utf-8", "replace").split(" ")


def windows_of(words: list[str], window: int = WINDOW) -> set[str]:
    """An item's windows, each with a space at either end."""
    words = [w for w in words if w]
    if not words:
        return set()
    return {" " + " ".join(words[i : i + window]) + " " for i in range(max(1, len(words) - window + 1))}


def item_blocks(items: list[tuple[str | None, str]], window: int = WINDOW, most: int = AUTOMATON_BYTES) -> Iterator[dict[str, tuple[int, list[str]]]]:
    """Windows to (number of words, ids of items that have it), in blocks of at most `most` bytes.
    Items are (id, words with one space between); windows of an item without an id have no id."""
    block: dict[str, tuple[int, list[str]]] = {}
    held = 0
    for item_id, text in items:
        for w in windows_of(text.split(" "), window):
            if w not in block:
                if held and held + len(w) > most:
                    yield block
                    block, held = {}, 0
                block[w] = (w.count(" ") - 1, [])
                held += len(w)
            if item_id is not None:
                block[w][1].append(item_id)
    if block:
        yield block


def _automaton(block: dict[str, tuple[int, list[str]]]) -> ahocorasick.Automaton:
    built = ahocorasick.Automaton()
    for window, value in block.items():
        built.add_word(window, value)
    built.make_automaton()
    return built


class Hits:
    """What has been found in one text: which words are inside a window's occurrence, and items."""

    def __init__(self, words: list[str]):
        self.text, self.n = f" {' '.join(words)} ", len(words)
        self.ends: list[tuple[int, int]] = []
        self.items: set[str] = set()

    def scan(self, automaton: ahocorasick.Automaton) -> None:
        for end, (n, having) in automaton.iter(self.text):
            self.ends.append((end, n))
            self.items.update(having)

    def mask(self) -> np.ndarray:
        hit = np.zeros(self.n + 1, dtype=np.int64)
        if self.ends:
            spaces = np.flatnonzero(np.frombuffer(self.text.encode("utf-32-le"), dtype="<u4") == 32)
            last = np.searchsorted(spaces, [e for e, _ in self.ends])  # number of the space that closes the window
            np.add.at(hit, last - np.array([n for _, n in self.ends]), 1)
            np.add.at(hit, last, -1)
        return np.cumsum(hit)[:-1] > 0


class Scanner:
    """Scans lists of texts for the items' windows; one automaton is alive at a time."""

    def __init__(self, items: list[tuple[str | None, str]], window: int = WINDOW, most: int = AUTOMATON_BYTES):
        self.items, self.window, self.most = items, window, most
        blocks = list(islice(self._blocks(), 2))
        self.several = len(blocks) > 1
        self.only = None if self.several else [_automaton(b) for b in blocks]

    def _blocks(self) -> Iterator[dict[str, tuple[int, list[str]]]]:
        return item_blocks(self.items, self.window, self.most)

    def __call__(self, texts: list[str | None]) -> list[Hits]:
        found = [Hits([w for w in normal(t) if w]) for t in texts]
        for automaton in self.only if self.only is not None else map(_automaton, self._blocks()):
            for hits in found:
                hits.scan(automaton)
        return found

    def rows(self) -> int:
        """Texts that are worth gathering for one call."""
        return 1 << 30 if self.several else 1000


def _gathered(column: pa.Array, rows: int, most: int = SCAN_BYTES) -> Iterator[tuple[int, int]]:
    """(start, stop) of runs of texts of at most `rows` texts and about `most` bytes."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(column):
        stop = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right"))
        stop = min(len(column), at + rows, max(at + 1, stop))
        yield at, stop
        at = stop


def _shared(docs: DataFrame, benchmark: DataFrame):
    """The items' words as a broadcast. Refuses a benchmark that is not small by nature."""
    size = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if size > BENCHMARK_BYTES:
        raise ValueError(f"a benchmark of {size} bytes is beyond {BENCHMARK_BYTES}: windows this many are no benchmark's")
    rows = benchmark.select(F.col("item_id").cast("string"), F.col("text").cast("string")).where("text is not null").distinct().orderBy("item_id", "text").collect()
    items = [(r[0], " ".join(w for w in normal(r[1]) if w)) for r in rows]
    return docs.sparkSession.sparkContext.broadcast([x for x in items if x[1]])


def hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, with_spans: bool = False) -> DataFrame:
    """One row per row of `docs`: doc_id, n_words, n_hit, n_items, items (sorted), and on demand
    spans: maximal runs of hit words as (start, stop) characters of the original text.

    Null and empty texts have no words; an item without words has no window; an empty benchmark
    hits nothing. Items with the same id count once. Windows of items without an id hit words, but
    no item is listed or counted for them. Repeated rows give repeated rows; other columns of either table are not read.
    """
    shared = _shared(docs, benchmark)
    schema = "doc_id long, n_words long, n_hit long, n_items long, items array<string>" + ", spans array<struct<start: int, stop: int>>" * with_spans

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(shared.value, window)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for a, b in _gathered(texts, scanner.rows()):
                some = texts.slice(a, b - a).to_pylist()
                rows = []
                for doc_id, text, found in zip(ids.slice(a, b - a).to_pylist(), some, scanner(some)):
                    mask = found.mask()
                    row = {"doc_id": doc_id, "n_words": found.n, "n_hit": int(mask.sum()), "n_items": len(found.items), "items": sorted(found.items)}
                    if with_spans:
                        row["spans"] = _spans(text, mask) if found.ends else []
                    rows.append(row)
                yield pa.RecordBatch.from_pylist(rows, schema=_arrow(with_spans))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def _arrow(with_spans: bool) -> pa.Schema:
    fields = [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items", pa.list_(pa.string()))]
    return pa.schema(fields + [("spans", pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())])))] * with_spans)


def _spans(text: str, mask: np.ndarray) -> list[dict[str, int]]:
    places = [m.span() for m in _ORIGINAL.finditer(text)]
    edges = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    return [{"start": places[a][0], "stop": places[b - 1][1]} for a, b in zip(edges[::2], edges[1::2])]


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, hit_share: int = HIT_SHARE) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for every document."""
    found = hits(docs, benchmark, window)
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), ((F.col("n_hit") > 0) & (hit_share * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, hit_share: int = HIT_SHARE) -> DataFrame:
    """The rows of `docs`, with all columns, that `contamination` does not mark. Null texts stay."""
    shared = _shared(docs, benchmark)
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(shared.value, window)
        for batch in batches:
            for a, b in _gathered(batch.column(place), scanner.rows()):
                part = batch.slice(a, b - a)
                found = [(h.n, int(h.mask().sum())) for h in scanner(part.column(place).to_pylist())]
                yield part.filter(pa.array([not (hit > 0 and hit_share * hit >= n) for n, hit in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def digest(items: list[str]) -> str:
    """The digest of an item list, as `contamination` gives it."""
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


#: DuckDB SQL for `contamination` with its default parameters.
ORACLE = r"""
with d as (select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
b as (select distinct cast(item_id as varchar) as item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
bw as (select item_id, least(len(w), 13) as k, unnest(list_transform(range(1, greatest(len(w) - 12, 1) + 1), lambda i: array_to_string(w[i : i + 12], ' '))) as win from b where len(w) > 0),
ks as (select distinct k from bw),
dw as (select r, k, i, array_to_string(w[i : i + k - 1], ' ') as win from (select r, w, k, unnest(range(1, len(w) - k + 2)) as i from d, ks where len(w) >= k)),
hit as (select dw.r, dw.i, dw.k, bw.item_id from dw join bw on dw.k = bw.k and dw.win = bw.win),
hw as (select r, count(distinct p) as n_hit from (select r, unnest(range(i, i + k)) as p from (select distinct r, i, k from hit)) group by r),
hi as (select r, count(*) as n_items, string_agg(item_id, ',' order by item_id) as ids from (select distinct r, item_id from hit where item_id is not null) group by r)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(ids, '')) as items_sha256,
  coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from d left join hw using (r) left join hi using (r)
"""
