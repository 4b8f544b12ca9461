"""Fuzzy path scores as column expressions; the query is a literal, the rest stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftwell.functions.text import depth, file_name

# Bonuses and penalties of a score.
EXACT_NAME, EXACT_STEM, NAME_PREFIX, IN_NAME = 300, 200, 120, 60
CONSECUTIVE, BOUNDARY, LEADING, LEADING_CAP, TYPO, DEPTH = 12, 18, 2, 40, 40, 3
GIT = {"modified": 24, "staged": 20, "untracked": 12}
# Age in seconds below which a boost holds.
RECENCY = [(120, 16), (900, 8), (3600, 4), (86_400, 2), (604_800, 1)]


def typo_budget(query: str) -> int:
    """How many characters of a query may be missing."""
    return min(6, max(2, len(query) // 4))


def recency_boost(mtime_ms: Column, now_ms: int) -> Column:
    """Nothing without a time; a time in the future is fresh."""
    age = (F.lit(now_ms) - mtime_ms) / 1000
    boost = F.lit(0)
    for limit, value in reversed(RECENCY):
        boost = F.when(age < limit, value).otherwise(boost)
    return F.when(mtime_ms.isNull() | (mtime_ms == 0), 0).otherwise(boost)


def git_boost(status: Column) -> Column:
    boost = F.lit(0)
    for name, value in GIT.items():
        boost = F.when(status == name, value).otherwise(boost)
    return boost


def match(path: Column, query: str) -> Column:
    """struct(at, typos, positions): the greedy leftmost subsequence, 1-based; a character that does
    not follow is a typo. Null when typos pass the budget or nothing is placed."""
    lowered = F.lower(path)
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("typos"), F.array().cast("array<int>").alias("positions"))

    def step(state: Column, char: Column) -> Column:
        found = F.call_function("locate", char, lowered, state["at"] + 1)
        hit = F.struct(found.alias("at"), state["typos"].alias("typos"), F.array_append(state["positions"], found).alias("positions"))
        miss = F.struct(state["at"].alias("at"), (state["typos"] + 1).alias("typos"), state["positions"].alias("positions"))
        return F.when(found > 0, hit).otherwise(miss)

    chars = F.array(*[F.lit(c) for c in query.lower()])
    walked = F.aggregate(chars, start, step)
    return F.when((walked["typos"] <= typo_budget(query)) & (F.size(walked["positions"]) > 0), walked)


def name_tier(path: Column, query: str) -> Column:
    """The first that holds: whole name, whole stem, start of the name, part of the name."""
    name, wanted = F.lower(file_name(path)), query.lower()
    bare = F.regexp_replace(name, r"(?s)^(.+)\.[^.]*$", "$1")
    return F.when(name == wanted, EXACT_NAME).when(bare == wanted, EXACT_STEM).when(name.startswith(wanted), NAME_PREFIX).when(name.contains(wanted), IN_NAME).otherwise(0)


def _boundaries(path: Column, positions: Column) -> Column:
    """How many positions start a part: the first character, after / _ - . or a camel-case hump."""

    def starts(at: Column) -> Column:
        before, own = F.substring(path, at - 1, F.lit(1)), F.substring(path, at, F.lit(1))
        hump = (before == F.lower(before)) & (own != F.lower(own))
        return (at == 1) | before.isin("/", "_", "-", ".") | hump

    return F.size(F.filter(positions, starts))


def _neighbours(positions: Column) -> Column:
    """How many positions directly follow the one before."""
    n = F.size(positions)
    later = F.when(n > 1, F.slice(positions, 2, F.greatest(n - 1, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    return F.size(F.filter(F.zip_with(positions, later, lambda a, b: b - a == 1), lambda same: F.coalesce(same, F.lit(False))))


def extras(frecency: Column, git: Column, mtime_ms: Column, now_ms: int) -> Column:
    return F.coalesce(frecency, F.lit(0)) + git_boost(git) + recency_boost(mtime_ms, now_ms)


def score_of(path: Column, found: Column, query: str) -> Column:
    """The part of the score that path and match decide."""
    positions = found["positions"]
    first = F.least(positions[0] - 1, F.lit(LEADING_CAP))
    return (name_tier(path, query) + CONSECUTIVE * _neighbours(positions) + BOUNDARY * _boundaries(path, positions) - LEADING * first - TYPO * found["typos"] - DEPTH * depth(path)).cast("int")
