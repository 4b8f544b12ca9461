"""Ignore rules: a file of patterns becomes one boolean column over paths."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """A regular expression over relative paths, and whether it takes paths back in."""

    regex: str
    negated: bool


def pattern_regex(pattern: str) -> str:
    """A leading slash anchors; a trailing one is dropped; `**` crosses directories, `*` and `?` do
    not; everything else is literal. A match also covers what lies below it."""
    anchored = pattern.startswith("/")
    body = pattern.removeprefix("/").removesuffix("/")
    wild = {"**": ".*", "*": "[^/]*", "?": "[^/]"}
    parts = re.split(r"(\*\*|\*|\?)", body)
    return ("^" if anchored else "(^|/)") + "".join(wild.get(p) or re.escape(p) for p in parts) + "(/|$)"


def parse_rules(text: str) -> list[Rule]:
    """Rules in order; blank lines and comments are dropped."""
    lines = [line.strip() for line in text.splitlines()]
    return [Rule(pattern_regex(line.removeprefix("!")), line.startswith("!")) for line in lines if line and not line.startswith("#")]


def ignored_name(path: Column, rules: list[Rule]) -> Column:
    """Whether the last rule that matches ignores the path; no match keeps it."""
    verdict = F.lit(False)
    for rule in rules:
        verdict = F.when(path.rlike(rule.regex), not rule.negated).otherwise(verdict)
    return verdict


def ignored(path: Column, rules: list[Rule]) -> Column:
    """Whether the path, or a directory above it, is ignored: what lies below an ignored directory
    stays hidden even if a later rule takes it back in."""
    if not rules:
        return F.lit(False)
    parts = F.split(path, "/")
    above = F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.concat(F.array_join(F.slice(parts, 1, n), "/"), F.lit("/")))).otherwise(F.array().cast("array<string>"))
    return ignored_name(path, rules) | F.exists(above, lambda d: ignored_name(d, rules))
