"""Keyset pages and validated query ranges."""

from __future__ import annotations

import math
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEFAULT_LIMIT, MAX_LIMIT, MAX_RANGE_DAYS = 100, 500, 7


def parse_limit(raw: object) -> int:
    """A page size: 100 unless a positive number is given, rounded down, 500 at most."""
    try:
        n = float(raw)  # type: ignore[arg-type]
    except (TypeError, ValueError):
        return DEFAULT_LIMIT
    if math.isnan(n) or n <= 0:
        return DEFAULT_LIMIT
    return int(min(n, MAX_LIMIT))


def parse_range(start: datetime | None, end: datetime | None, now: datetime) -> tuple[datetime, datetime]:
    """A half-open time range: the last 7 days by default; inverted or longer ones are refused."""
    end = end or now
    start = start or end - timedelta(days=MAX_RANGE_DAYS)
    if start >= end:
        raise ValueError("the range must start before it ends")
    if end - start > timedelta(days=MAX_RANGE_DAYS):
        raise ValueError(f"the range must not exceed {MAX_RANGE_DAYS} days")
    return start, end


def within(rows: DataFrame, column: str, start: object, end: object) -> DataFrame:
    return rows.where((F.col(column) >= F.lit(start)) & (F.col(column) < F.lit(end)))


def after(log: DataFrame, feed_column: str, feed: str, sequence: str, seen: int) -> DataFrame:
    """What a feed's log has beyond the last sequence seen: two filters that reach the scan; a stream keeps ``seen`` as its checkpoint."""
    return log.where((F.col(feed_column) == feed) & (F.col(sequence) > seen))


def matching(rows: DataFrame, **wanted: object) -> DataFrame:
    """Rows equal to every given value; filters that are None are left out."""
    for column, value in wanted.items():
        if value is not None:
            rows = rows.where(F.col(column) == F.lit(value))
    return rows


def page(rows: DataFrame, cursor: str, after: object, limit: int, order: list[Column] | None = None, descending: bool = False) -> DataFrame:
    """One page beyond a cursor, a top-k over the ordering, never a full sort."""
    if after is not None:
        rows = rows.where(F.col(cursor) < F.lit(after)) if descending else rows.where(F.col(cursor) > F.lit(after))
    return rows.orderBy(*(order or [F.col(cursor).desc() if descending else F.col(cursor)])).limit(limit)


def next_cursor(rows: list, cursor: str, limit: int) -> object:
    """Where the next page starts: None unless this one is full."""
    return rows[-1][cursor] if len(rows) == limit else None
