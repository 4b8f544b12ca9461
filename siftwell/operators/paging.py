"""Offset pages over a total order."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame


@dataclass(frozen=True)
class Page:
    """Rows of one page (lazy), the number of all, and the offset of the next page as text or None.
    `exact` is false when `total` is a lower bound."""

    items: DataFrame
    total: int
    cursor: str | None
    exact: bool = True


def offset_of(cursor: str | None) -> int:
    """The leading integer of a cursor; anything else, or below one, is the start."""
    found = re.match(r"\s*[+-]?\d+", cursor or "")
    return max(0, int(found.group())) if found else 0


def page_of(rows: DataFrame, order: list[Column], limit: int, cursor: str | None = None, bounded: bool = False) -> Page:
    """The page at `cursor`. Only the page is sorted to the front (a top-k plan); the total is a
    count beside it, or with `bounded` the count of one row more than the page needs."""
    start = offset_of(cursor)
    ordered = rows.orderBy(*order)
    budget = start + limit + 1
    total = ordered.limit(budget).count() if bounded else rows.count()
    end = min(total, start + limit)
    return Page(ordered.offset(start).limit(limit), total, str(end) if start < end < total else None, not bounded or total < budget)
