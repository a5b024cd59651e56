"""Retention and storage budget as set operations on rows: what survives, and which hosts are affected."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logloom.schema import InvalidInput

TEXTS = ("timestamp", "hostname", "facility", "severity", "app_name", "process_id", "message", "raw", "source_ip")


def row_bytes(logs: DataFrame) -> Column:
    """The size of a row for the budget: the bytes of its texts."""
    return sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in TEXTS if c in logs.columns), F.lit(0)).cast("bigint")


def retained(logs: DataFrame, cutoff) -> DataFrame:
    """Rows that arrived at or after the cutoff; None keeps all."""
    return logs if cutoff is None else logs.where(F.col("received_at") >= cutoff)


def oldest(logs: DataFrame, n: int) -> DataFrame:
    """The n rows that arrived first, ties to the smaller id."""
    return logs.orderBy("received_at", "id").limit(n)


def sums_by(logs: DataFrame, level: str) -> list[tuple]:
    """(start, bytes, rows) of each minute or second of arrival that has rows."""
    sums = logs.groupBy(F.date_trunc(level, "received_at").alias("at")).agg(F.sum(row_bytes(logs)).alias("s"), F.count("*").alias("n"))
    return [(r["at"], r["s"], r["n"]) for r in sums.collect()]


def walk(sums: list[tuple], measure: int, room: int, newest_first: bool) -> tuple[int, int, object]:
    """How many rows of whole spans fit into room from one end, what room is left, and the span that does not fit whole.

    sums holds (span, bytes, rows); measure says which of the two counts: 1 or 2.
    """
    passed = 0
    for span in sorted(sums, reverse=newest_first):
        if span[measure] > room:
            return passed, room, span[0]
        room, passed = room - span[measure], passed + span[2]
    return passed, room, None


def edge(logs: DataFrame, sums: list[tuple], measure: int, room: int, newest_first: bool) -> tuple[int, tuple | None]:
    """How many rows from one end of the order (received_at, id) fit into room, and the first that does not (None: all fit).

    sums are those by minute. Of one minute the seconds are summed, and only the rows of one second are put in order.
    """
    passed, room, at = walk(sums, measure, room, newest_first)
    if at is None:
        return passed, None
    kind, got, rows = logs.schema["received_at"].dataType, F.col("received_at"), logs
    inside = lambda at, span: (got >= F.lit(at).cast(kind)) & (got < F.lit(at + span).cast(kind))
    rows = logs.where(inside(at, timedelta(minutes=1)))
    more, room, at = walk(sums_by(rows, "second"), measure, room, newest_first)
    size = row_bytes(logs) if measure == 1 else F.lit(1)
    end = (lambda c: F.col(c).desc()) if newest_first else F.col
    order = Window.orderBy(end("received_at"), end("id"))
    running = rows.where(inside(at, timedelta(seconds=1))).select("received_at", "id", F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("sum"), F.row_number().over(order).alias("nth"))
    first = running.where(F.col("sum") > room).agg(F.min(F.struct("nth", "received_at", "id")).alias("first")).first()["first"]
    return passed + more + first["nth"] - 1, (first["received_at"], first["id"])


def budget_cutoff(logs: DataFrame, max_bytes: int, chunk: int = 2000) -> tuple[int, tuple | None]:
    """How many rows go when chunks of the oldest do until at most max_bytes remain, and (received_at, id) of the oldest that stays.

    One pass sums all rows by minute, of which the driver holds a line each; after it only two minutes are read.
    """
    sums = sums_by(logs, "minute")
    total = sum(n for _, _, n in sums)
    kept, over = edge(logs, sums, 1, max_bytes, newest_first=True)
    if over is None:
        return 0, None
    gone = min(total, -(-(total - kept) // chunk) * chunk)
    return gone, edge(logs, sums, 2, gone, newest_first=False)[1]


def not_before(logs: DataFrame, first: tuple) -> DataFrame:
    """Rows from (received_at, id) on in order of arrival."""
    at, i = F.lit(first[0]).cast(logs.schema["received_at"].dataType), F.lit(first[1])
    return logs.where((F.col("received_at") >= at) & ((F.col("received_at") > at) | (F.col("id") >= i)))


def budget_survivors(logs: DataFrame, max_bytes: int, chunk: int = 2000) -> DataFrame:
    """The rows left when chunks of the oldest go until at most max_bytes remain."""
    gone, first = budget_cutoff(logs, max_bytes, chunk)
    return logs if not gone else logs.where("false") if first is None else not_before(logs, first)


@dataclass(frozen=True)
class Budget:
    """Storage limits in MB; 0 switches one off."""

    max_mb: int = 1024
    recovery_mb: int = 900
    min_free_mb: int = 512
    recovery_free_mb: int = 768
    interval_secs: int = 60
    chunk: int = 2000

    def __post_init__(self):
        if self.max_mb and not 0 < self.recovery_mb < self.max_mb or not self.max_mb and self.recovery_mb:
            raise InvalidInput("recovery size must be below the maximum, and 0 without one")
        if self.min_free_mb and not self.recovery_free_mb > self.min_free_mb or not self.min_free_mb and self.recovery_free_mb:
            raise InvalidInput("recovery free space must be above the minimum, and 0 without one")
        if self.interval_secs < 5 or not 0 < self.chunk <= 1_000_000:
            raise InvalidInput("the interval is at least 5 seconds, a chunk 1 to 1000000 rows")

    @property
    def enabled(self) -> bool:
        return bool(self.max_mb or self.min_free_mb)

    def triggered(self, size: int, free: int | None) -> bool:
        return bool(self.max_mb and size > self.max_mb << 20 or self.min_free_mb and (free or 0) < self.min_free_mb << 20)

    def recovered(self, size: int, free: int | None) -> bool:
        return not (self.max_mb and size > self.recovery_mb << 20 or self.min_free_mb and (free or 0) < self.recovery_free_mb << 20)
