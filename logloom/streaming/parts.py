"""The parts of a store: folders of rows, each of one day of arrival, with what is known of them without reading any.

A part's row counts, bytes and least and greatest times serve as zone map for readers, as running totals for figures, and
tell upkeep which parts to drop, rewrite or merge. Times are microseconds since the epoch, days are UTC.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import UTC, datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.operators.lifecycle import row_bytes

DAY = 86_400_000_000
#: Parts of one day and level that are merged into one of the next level, and the level of a finished day's sorted parts.
FAN_IN, SORTED = 50, 99


@dataclass(frozen=True)
class Part:
    """dated counts rows whose time could be read; stamps are times as text; index names the folder of its postings."""

    path: str
    day: int
    n: int
    dated: int
    bytes: int
    first_ts: int | None
    last_ts: int | None
    first_received: int
    last_received: int
    first_stamp: str
    last_stamp: str
    level: int = 0
    index: str | None = None


def micros(at: datetime | None) -> int | None:
    """An instant as microseconds; without an offset it is UTC."""
    return None if at is None else ((at if at.tzinfo else at.replace(tzinfo=UTC)) - datetime(1970, 1, 1, tzinfo=UTC)) // timedelta(microseconds=1)


def day_of(received_at: Column) -> Column:
    """Days since the epoch."""
    return F.floor(F.unix_micros(received_at) / F.lit(DAY)).cast("long")


def figures(rows: DataFrame, *by: str) -> list[dict]:
    """What a Part tells of rows, by columns, in one pass."""
    at, got = F.unix_micros("ts"), F.unix_micros("received_at")
    sums = rows.groupBy(*by).agg(
        F.count("*").alias("n"), F.count("ts").alias("dated"), F.sum(row_bytes(rows)).alias("bytes"), F.min(at).alias("first_ts"), F.max(at).alias("last_ts"),
        F.min(got).alias("first_received"), F.max(got).alias("last_received"), F.min("timestamp").alias("first_stamp"), F.max("timestamp").alias("last_stamp"),
    )
    return [r.asDict() for r in sums.collect()]


def within(parts: list[Part], start: datetime | None, end: datetime | None) -> list[Part]:
    """The parts that can hold a row of a time from start to end, both inclusive; with a bound, rows without a time meet none."""
    lo, hi = micros(start), micros(end)
    if lo is None and hi is None:
        return parts
    return [p for p in parts if p.dated and (lo is None or p.last_ts >= lo) and (hi is None or p.first_ts <= hi)]


def newest_first(parts: list[Part]) -> list[Part]:
    """By the latest time a part can hold; parts without any last."""
    return sorted(parts, key=lambda p: (p.dated > 0, p.last_ts or 0), reverse=True)


def latest_above(parts: list[Part]) -> int | None:
    """The latest time that any of the parts can hold; None if they hold none."""
    return max((p.last_ts for p in parts if p.dated), default=None)


def to_merge(parts: list[Part], today: int, rows: int) -> list[list[Part]]:
    """Groups of parts to make one of: what is not sorted yet of a finished day, else FAN_IN of a level of a day.

    Late rows of a finished day make small sorted parts beside the large ones; FAN_IN parts of less than `rows` are merged too,
    or of less than half as many if they are sorted, since the slices of a large day have somewhat less than `rows`.
    """
    groups = []
    for day in sorted({p.day for p in parts}):
        here = [p for p in parts if p.day == day]
        raw = [p for p in here if p.level < SORTED]
        if day < today and raw:
            groups.append(raw)
        for level in sorted({p.level for p in here}):
            same = [p for p in here if p.level == level and p.n < (rows / 2 if level == SORTED else rows)]
            groups += [same] if len(same) >= FAN_IN and not (day < today and level < SORTED) else []
    return groups
