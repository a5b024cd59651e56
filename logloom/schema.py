"""Columns, types and fixed names of the log model."""

from __future__ import annotations

from pyspark.sql import types as T

# Severity names by number, most severe first, and facility names by number.
SEVERITIES = ("emerg", "alert", "crit", "err", "warning", "notice", "info", "debug")
FACILITIES = (
    "kern", "user", "mail", "daemon", "auth", "syslog", "lpr", "news", "uucp", "cron", "authpriv", "ftp",
    "ntp", "audit", "alert", "clock", "local0", "local1", "local2", "local3", "local4", "local5", "local6", "local7",
)
ERROR_SEVERITIES = ("emerg", "alert", "crit", "err", "warning")

#: What a query returns of a log row; raw is stored only.
LOG_COLS = ("id", "timestamp", "hostname", "facility", "severity", "app_name", "process_id", "message", "received_at", "source_ip")

_text = lambda name, null=True: T.StructField(name, T.StringType(), null)
LOGS = T.StructType([
    T.StructField("id", T.LongType(), False), _text("timestamp", False), T.StructField("ts", T.TimestampType()), T.StructField("ts_nanos", T.LongType()),
    _text("hostname", False), _text("facility"), _text("severity", False), _text("app_name"), _text("process_id"), _text("message", False), _text("raw", False),
    T.StructField("received_at", T.TimestampType(), False), _text("source_ip", False), T.StructField("tokens", T.ArrayType(T.StringType())),
])
HOSTS = T.StructType([_text("hostname", False), T.StructField("first_seen", T.TimestampType()), T.StructField("last_seen", T.TimestampType()), T.StructField("log_count", T.LongType())])
CHECKPOINTS = T.StructType([_text("host_name", False), _text("container_id", False), _text("last_timestamp"), T.StructField("updated_at", T.TimestampType())])


class InvalidInput(ValueError):
    """A request that can't be answered as it stands."""


class QueryFailed(RuntimeError):
    """A search expression with a syntax error; the text says no more than that."""


class Busy(RuntimeError):
    """Another writer holds the store; the request may be tried again."""
