"""Line search: literal, regular expression or fuzzy, narrowed by the trigram index.

Candidates are always verified, so the index changes the time of a search and never its answer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.functions.score import typo_budget
from siftwell.functions.text import bytes_look_binary, looks_binary, searchable
from siftwell.operators.paging import Page, page_of
from siftwell.operators.trigrams import Index, narrow, text_of
from siftwell.plans import planner

MODES = ("literal", "regex", "fuzzy")
SCHEMA = "path string, line int, text string, start int, stop int"


def lines_of(text: Column) -> Column:
    """Array of lines; a final line end gives a last empty line."""
    return F.split(text, "\r?\n", -1)


def java_pattern(pattern: str, ignore_case: bool) -> str:
    """The pattern as `rlike` takes it: Unicode case, and word boundaries that follow `\\w`."""
    out, at, inside = "", 0, False
    while at < len(pattern):
        two = pattern[at : at + 2]
        if two[:1] == "\\":
            out += {"\\b": r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))", "\\B": r"(?:(?<=\w)(?=\w)|(?<!\w)(?!\w))"}.get(two, two) if not inside else two
            at += 2
            continue
        inside = (inside or two[:1] == "[") and two[:1] != "]"
        out += two[:1]
        at += 1
    return f"(?iu){out}" if ignore_case else out


def check_pattern(spark: SparkSession, pattern: str) -> None:
    """Raises ValueError on a pattern that does not compile: an error is never an empty page."""
    try:
        spark._jvm.java.util.regex.Pattern.compile(pattern)
    except Exception as e:
        raise ValueError(f"Invalid regex pattern: {pattern}") from e


def fuzzy_spans(lines: list[str | None], needle: str, budget: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For lines that hold something like `needle`: their numbers, starts and ends. From the leftmost
    start that works, the needle's characters follow in order within a reach, at most `budget` of
    them missing. All starts of all lines advance together, one needle character at a time."""
    texts = [(t or "").lower() for t in lines]
    reach = max(3 * len(needle), len(needle) + 8)
    lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    ends = np.cumsum(lengths)
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    n = len(codes)
    if not n:
        return (np.empty(0, np.int64),) * 3
    place = np.arange(n, dtype=np.int32)
    line = np.repeat(np.arange(len(texts), dtype=np.int32), lengths)
    last = np.minimum(ends[line], place + np.int64(reach) + 1)  # the first place out of reach
    following = {}
    for c in set(needle):
        at = np.append(np.where(codes == ord(c), place, np.int32(n)), np.int32(n))
        following[c] = np.minimum.accumulate(at[::-1])[::-1]
    at, missing = place.copy(), np.zeros(n, dtype=np.int16)
    for c in needle:
        found = following[c][at]
        hit = found < last
        at = np.where(hit, found + 1, at)
        missing += ~hit
    good = np.flatnonzero((missing <= budget) & (missing < len(needle)))
    numbers, first = np.unique(line[good], return_index=True)
    starts = good[first]
    base = ends[numbers] - lengths[numbers]
    return numbers.astype(np.int64), starts - base, at[starts] - base


def _fuzzy(needle: str, budget: int, characters: int = 200_000):
    @F.pandas_udf("struct<start: int, stop: int>")
    def spans(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in parts:
            lines = texts.tolist()
            start, stop = np.full(len(lines), -1, dtype=np.int64), np.full(len(lines), -1, dtype=np.int64)
            a = 0
            while a < len(lines):
                b, held = a, 0
                while b < len(lines) and (b == a or held < characters):
                    held += len(lines[b] or "")
                    b += 1
                numbers, starts, stops = fuzzy_spans(lines[a:b], needle, budget)
                start[a + numbers], stop[a + numbers] = starts, stops
                a = b
            none = pd.Series(start < 0)
            yield pd.DataFrame({"start": pd.Series(start).astype("Int32").mask(none), "stop": pd.Series(stop).astype("Int32").mask(none)})

    return spans


def match_lines(lines: DataFrame, pattern: str, mode: str = "literal", ignore_case: bool = True) -> DataFrame:
    """`lines` (any columns and `text`) that match, with start (from 0) and stop of the first match."""
    text = F.col("text")
    if mode == "literal":
        hay, needle = (F.lower(text), F.lower(F.lit(pattern))) if ignore_case else (text, F.lit(pattern))
        at = F.call_function("locate", needle, hay)
        return lines.where(hay.contains(needle)).withColumns({"start": (at - 1).cast("int"), "stop": (at - 1 + F.length(needle)).cast("int")})
    if mode == "regex":
        java = java_pattern(pattern, ignore_case)
        check_pattern(lines.sparkSession, java)
        hits = lines.where(text.rlike(java))
        at = F.regexp_instr(text, F.lit(java))
        return hits.withColumns({"start": (at - 1).cast("int"), "stop": (at - 1 + F.length(F.coalesce(F.regexp_substr(text, F.lit(java)), F.lit("")))).cast("int")})
    if mode != "fuzzy":
        raise ValueError(f"mode must be one of {MODES}")
    needle = pattern.lower()
    span = _fuzzy(needle, typo_budget(pattern))(text)
    return lines.withColumn("_span", span).where("_span.start is not null").select(*lines.columns, "_span.start", "_span.stop")


def plan_of(pattern: str, mode: str, ignore_case: bool) -> planner.Plan:
    if mode == "literal":
        return planner.for_literal(pattern)
    return planner.for_regex(pattern, ignore_case) if mode == "regex" else planner.All()


def checked_plan(spark: SparkSession, pattern: str, mode: str, ignore_case: bool) -> planner.Plan:
    """The plan, after the mode and a regular expression are known to be valid."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    if mode == "regex" and pattern != "":
        check_pattern(spark, java_pattern(pattern, ignore_case))
    return plan_of(pattern, mode, ignore_case)


def grep_lines(files: DataFrame, pattern: str, mode: str = "literal", ignore_case: bool = True, index: Index | None = None, glob: str | None = None, rarest: DataFrame | None = None, longest: int | None = None) -> DataFrame:
    """path, line (from 1), text, start, stop of every matching line of `files` (file_id, path, size,
    content and perhaps alive). An empty pattern matches nothing; `glob` without its stars must be
    part of the path. Binary files, by name or by a NUL near the start, are left out. Text is whole,
    or cut to `longest` characters once it has matched."""
    spark = files.sparkSession
    plan = checked_plan(spark, pattern, mode, ignore_case)
    if pattern == "":
        return spark.createDataFrame([], SCHEMA)
    alive = F.col("alive") if "alive" in files.columns else F.lit(True)
    wanted = files.where(alive & searchable(F.col("path"), F.col("size")))
    if glob:
        wanted = wanted.where(F.col("path").contains(glob.replace("*", "")))
    if index is not None:
        wanted, _ = narrow(wanted, index, plan, rarest)
    sniffed = bytes_look_binary(F.col("content")) if dict(files.dtypes)["content"] == "binary" else looks_binary(F.col("content"))
    text = text_of(files)
    whole = wanted.where(~sniffed)
    if mode == "literal":
        # A line can only hold what its file holds: files without the literal are not split.
        whole = whole.where((F.lower(text) if ignore_case else text).contains(F.lower(F.lit(pattern)) if ignore_case else F.lit(pattern)))
    lines = whole.select("path", F.posexplode(lines_of(text)).alias("n", "text")).select("path", (F.col("n") + 1).cast("int").alias("line"), "text")
    shown = F.col("text") if longest is None else F.substring("text", 1, longest)
    return match_lines(lines, pattern, mode, ignore_case).select("path", "line", shown.alias("text"), "start", "stop")


def grep(files: DataFrame, pattern: str, mode: str = "literal", ignore_case: bool = True, index: Index | None = None, glob: str | None = None, limit: int = 20, cursor: str | None = None, early_stop: bool = False, rarest: DataFrame | None = None) -> Page:
    """One page of matches by path, then line. With `early_stop`, a search that nothing narrows takes
    one hit more than the page needs, and its total is a lower bound (`exact` false)."""
    hits = grep_lines(files, pattern, mode, ignore_case, index, glob, rarest)
    narrowed = index is not None and not isinstance(plan_of(pattern, mode, ignore_case), planner.All)
    return page_of(hits, [F.col("path"), F.col("line")], limit, cursor, bounded=early_stop and not narrowed)


def scanned(files: DataFrame, pattern: str, mode: str, ignore_case: bool, index: Index) -> int:
    """How many files a search verifies."""
    pool, _ = narrow(files.where(searchable(F.col("path"), F.col("size"))), index, plan_of(pattern, mode, ignore_case))
    return pool.select("file_id").count()
