"""Fuzzy path lookup, ranked by match, frecency, git status and recency."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.functions.score import extras, match, score_of
from siftwell.operators.paging import Page, page_of


def score_paths(files: DataFrame, query: str, now_ms: int, frecency: DataFrame | None = None) -> DataFrame:
    """`files` (path and perhaps frecency, git, mtime_ms, alive) that match, with score and positions
    (from 0). An empty query matches everything, without positions. `frecency` (path, frecency) joins
    on the path; content is never read."""
    own = files.drop("content")
    if "alive" in own.columns:
        own = own.where("alive")
    if frecency is not None:
        own = own.drop("frecency").join(frecency.select("path", "frecency"), "path", "left")
    column = lambda name, kind: F.col(name) if name in own.columns else F.lit(None).cast(kind)
    more = extras(column("frecency", "int"), column("git", "string"), column("mtime_ms", "long"), now_ms)
    if query == "":
        return own.withColumns({"score": more.cast("int"), "positions": F.array().cast("array<int>")})
    found = own.withColumn("_match", match(F.col("path"), query)).where(F.col("_match").isNotNull())
    scored = found.withColumns({"score": (score_of(F.col("path"), F.col("_match"), query) + more).cast("int"), "positions": F.transform(F.col("_match.positions"), lambda p: p - 1)})
    return scored.drop("_match")


def find(files: DataFrame, query: str, now_ms: int, limit: int = 20, cursor: str | None = None, frecency: DataFrame | None = None, collation: str | None = None) -> Page:
    """One page, best first, ties by path: by bytes, or under `collation` (such as UNICODE)."""
    scored = score_paths(files, query, now_ms, frecency)
    path = F.col("path") if collation is None else F.collate(F.col("path"), collation)
    return page_of(scored, [F.desc("score"), path], limit, cursor)


def find_tool(files: DataFrame, query: str, now_ms: int, limit: int | None = None, cursor: str | None = None, frecency: DataFrame | None = None) -> Page:
    """As a caller's tool: the query is trimmed and the limit held between 1 and 100."""
    return find(files, query.strip(), now_ms, min(100, max(1, limit if limit is not None else 20)), cursor, frecency)
