"""Row filters of log queries: each given option adds one condition."""

from __future__ import annotations

from datetime import datetime
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.functions.match import matches
from logloom.schema import LOG_COLS, SEVERITIES, InvalidInput


def at_or_above(severity_min: str) -> list[str]:
    """The names of a severity and all more severe ones."""
    if severity_min not in SEVERITIES:
        raise InvalidInput(f"unknown severity {severity_min!r}; one of {', '.join(SEVERITIES)}")
    return list(SEVERITIES[: SEVERITIES.index(severity_min) + 1])


def when_filter(logs: DataFrame, start: datetime | None, end: datetime | None, order: str = "instant") -> list[Column]:
    """Conditions on the time, both ends inclusive. Order text compares the stored texts instead of the instants."""
    naive = dict(logs.dtypes).get("ts") == "timestamp_ntz"

    def bound(at: datetime) -> Column:
        if order == "text":
            return F.lit(at.isoformat())
        return F.lit(at.replace(tzinfo=None)).cast("timestamp_ntz") if naive else F.lit(at)

    column = F.col("timestamp" if order == "text" else "ts")
    return [c for c in (None if start is None else column >= bound(start), None if end is None else column <= bound(end)) if c is not None]


def filtered(logs: DataFrame, *, query=None, hostname=None, source_ip=None, severity=None, severity_in=None, app_name=None, start=None, end=None, order="instant") -> DataFrame:
    """Rows that meet every given option. An empty severity_in is no option. Null columns never match."""
    same = {"hostname": hostname, "source_ip": source_ip, "severity": severity, "app_name": app_name}
    conditions = [F.col(name) == value for name, value in same.items() if value is not None]
    if severity_in:
        conditions.append(F.col("severity").isin(list(severity_in)))
    conditions += when_filter(logs, start, end, order)
    if query is not None:
        conditions.append(matches(F.col("tokens"), query))
    return logs.where(reduce(and_, conditions)) if conditions else logs


def log_columns(logs: DataFrame) -> DataFrame:
    return logs.select(*LOG_COLS)


def newest(logs: DataFrame, limit: int) -> DataFrame:
    """The latest rows, newest first, ties to the larger id."""
    return logs.orderBy(F.col("ts").desc(), F.col("id").desc()).limit(limit)
