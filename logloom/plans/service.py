"""The request surface: search, tail, errors, hosts, correlate, stats and help over a logs DataFrame."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logloom.functions.parse import megabytes
from logloom.functions.timeutil import parse_rfc3339, render_utc
from logloom.operators import aggregates
from logloom.operators.filters import at_or_above, filtered, log_columns, newest
from logloom.operators.lifecycle import Budget
from logloom.schema import LOG_COLS, InvalidInput
from logloom.streaming.parts import latest_above, newest_first, within
from logloom.streaming.postings import candidates
from logloom.streaming.store import LogStore

SEARCH_LIMIT, SEARCH_CAP, TAIL_LIMIT, TAIL_CAP = 100, 1000, 50, 500
CORRELATE_LIMIT, CORRELATE_CAP, WINDOW_MINUTES, WINDOW_CAP = 500, 999, 5, 60
ACTIONS = ("search", "tail", "errors", "hosts", "correlate", "stats", "help")

HELP = """# Log queries

- search: query, hostname, source_ip, severity, app_name, from, to, limit (100, at most 1000)
- tail: hostname, source_ip, app_name, n (50, at most 500)
- errors: from, to
- hosts
- correlate: reference_time (required), window_minutes (5, at most 60), severity_min (warning), hostname, source_ip, query, limit (500, at most 999)
- stats

A query is words, "phrases", prefix*, ^first, NEAR(a b, n), AND, OR, NOT and parentheses. Words are stemmed, in phrases too.
Rows come newest first. Times are RFC 3339 with an offset.
"""


def number(value, default: int, cap: int, name: str) -> int:
    """A count from a request: missing or of another type gives the default; over 32 bits is an error; the cap holds."""
    if isinstance(value, bool) or not isinstance(value, int) or value < 0:
        return default
    if value > 0xFFFFFFFF:
        raise InvalidInput(f"{name} must be <= {0xFFFFFFFF}")
    return min(value, cap)


@dataclass
class Correlation:
    """Events around an instant: rows newest first, by host, and one row of truncated, total_events and total_hosts."""

    reference_time: str
    window_from: str
    window_to: str
    severity_min: str
    events: DataFrame
    hosts: DataFrame
    summary: DataFrame


@dataclass(frozen=True)
class Storage:
    """What stats tell about storage: bytes of texts, of files, and free, beside the budget."""

    logical: int
    physical: int
    free: int | None
    budget: Budget


class LogEngine:
    """Answers requests over logs (with ts and, for full-text search, tokens), a host registry and storage figures."""

    def __init__(self, logs: DataFrame, hosts: DataFrame | None = None, storage: Storage | None = None):
        self.logs, self.registry, self.storage = logs, hosts, storage

    def rows(self, start: datetime | None = None, end: datetime | None = None, **_) -> DataFrame:
        """Rows among which all of a time from start to end are."""
        return self.logs

    def newest(self, limit: int, **conditions) -> DataFrame:
        return newest(filtered(self.rows(**conditions), **conditions), limit)

    def counts(self) -> DataFrame:
        return aggregates.counts(self.logs, self.registry)

    @staticmethod
    def _bounds(params: dict) -> dict:
        return {name: parse_rfc3339(params[key], key) for name, key in (("start", "from"), ("end", "to")) if params.get(key) is not None}

    def search(self, **params) -> DataFrame:
        """The newest rows that meet all given options; an unknown severity meets none."""
        same = {k: params.get(k) for k in ("query", "hostname", "source_ip", "severity", "app_name")}
        return log_columns(self.newest(number(params.get("limit"), SEARCH_LIMIT, SEARCH_CAP, "limit"), **same, **self._bounds(params)))

    def tail(self, **params) -> DataFrame:
        return log_columns(self.newest(number(params.get("n"), TAIL_LIMIT, TAIL_CAP, "n"), **{k: params.get(k) for k in ("hostname", "source_ip", "app_name")}))

    def errors(self, **params) -> DataFrame:
        bounds = self._bounds(params)
        return aggregates.error_summary(filtered(self.rows(**bounds), **bounds))

    def hosts(self, live: bool = False) -> DataFrame:
        """The registry, which counts rows as they came in, or with live the rows there are; last seen first."""
        found = aggregates.live_hosts(self.logs) if live or self.registry is None else self.registry
        return found.orderBy(F.col("last_seen").desc(), "hostname")

    def correlate(self, **params) -> Correlation:
        """Rows of at least severity_min within some minutes of reference_time; over the limit, the oldest go."""
        if not params.get("reference_time"):
            raise InvalidInput("reference_time is required")
        at = parse_rfc3339(params["reference_time"], "reference_time")
        delta = timedelta(minutes=number(params.get("window_minutes"), WINDOW_MINUTES, WINDOW_CAP, "window_minutes"))
        limit = number(params.get("limit"), CORRELATE_LIMIT, CORRELATE_CAP, "limit")
        severity_min = params.get("severity_min") or "warning"
        same = {k: params.get(k) for k in ("query", "hostname", "source_ip")}
        bounds = {"start": at - delta, "end": at + delta}
        found = filtered(self.rows(**bounds, query=same["query"]), **same, severity_in=at_or_above(severity_min), **bounds)
        # The answer's three tables are plans over the window of at most CORRELATE_CAP + 1 rows; nothing is read before one is asked for.
        events, nth = newest(found, limit), F.row_number().over(Window.orderBy(F.col("ts").desc(), F.col("id").desc()))
        shown = newest(found, limit + 1).select("hostname", (nth <= limit).alias("shown"))
        summary = shown.agg((F.count("*") > limit).alias("truncated"), F.count_if("shown").alias("total_events"), F.count_distinct(F.when(F.col("shown"), F.col("hostname"))).alias("total_hosts"))
        return Correlation(params["reference_time"], render_utc(at - delta), render_utc(at + delta), severity_min, log_columns(events), aggregates.by_host(events), summary)

    def stats(self) -> DataFrame:
        """One row of counts; with storage figures, also sizes in MB as text, the limits and whether writing is blocked."""
        found, s = self.counts(), self.storage
        if s is None:
            return found
        mb = lambda n: megabytes(F.lit(n).cast("long"))
        limits = {"max_db_size_mb": F.lit(s.budget.max_mb).cast("long"), "min_free_disk_mb": F.lit(s.budget.min_free_mb).cast("long")}
        return found.withColumns({"logical_db_size_mb": mb(s.logical), "physical_db_size_mb": mb(s.physical), "free_disk_mb": mb(s.free), **limits, "write_blocked": F.lit(s.budget.triggered(s.logical, s.free))})

    def help(self) -> str:
        return HELP

    def health(self) -> bool:
        return self.logs.sparkSession.range(1).count() == 1

    def run(self, action: str, **params):
        """The answer to a named action."""
        if action not in ACTIONS:
            raise InvalidInput(f"unknown action {action!r}; one of {', '.join(ACTIONS)}")
        return getattr(self, action)(**params)


class StoreEngine(LogEngine):
    """Answers requests over a store as it is now; parts that cannot hold a row of the answer are not read."""

    def __init__(self, store: LogStore, budget: Budget | None = None):
        self.store, self.parts = store, store.state()["parts"]
        now = store.metrics() if budget else None
        super().__init__(store.rows_of(self.parts), store.hosts(), now and Storage(now.logical, now.physical, now.free, budget))

    def rows(self, start: datetime | None = None, end: datetime | None = None, query: str | None = None, **_) -> DataFrame:
        return candidates(self.store, within(self.parts, start, end), query)

    def newest(self, limit: int, start: datetime | None = None, end: datetime | None = None, **conditions) -> DataFrame:
        """The newest parts are read first, four times as many each time, until none of the others can hold a newer row.

        A row is sure of its place if it is later than all that the unread parts can hold. Without conditions the parts' counts
        tell that enough are; else they are counted, up to limit.
        """
        parts, given = newest_first(within(self.parts, start, end)), any(v is not None for v in (start, end, *conditions.values()))
        take = 1
        while take < len(parts):
            read, floor = parts[:take], latest_above(parts[take:])
            found = filtered(candidates(self.store, read, conditions.get("query")), start=start, end=end, **conditions)
            sure = found.where("ts IS NOT NULL" if floor is None else F.unix_micros("ts") > floor)
            if given and sure.limit(limit).count() >= limit or not given and sum(p.dated for p in read if p.dated and (floor is None or p.first_ts > floor)) >= limit:
                return newest(sure, limit)
            take *= 4
        return newest(filtered(candidates(self.store, parts, conditions.get("query")), start=start, end=end, **conditions), limit)

    def counts(self) -> DataFrame:
        """From the parts' figures; only the registry is read."""
        stamps = (min((p.first_stamp for p in self.parts), default=None), max((p.last_stamp for p in self.parts), default=None))
        figures = {"oldest_log": F.lit(stamps[0]).cast("string"), "newest_log": F.lit(stamps[1]).cast("string"), "phantom_fts_rows": F.lit(0).cast("long")}
        return self.registry.agg(F.count("*").alias("total_hosts")).select(F.lit(sum(p.n for p in self.parts)).cast("long").alias("total_logs"), "total_hosts", *(v.alias(k) for k, v in figures.items()))
