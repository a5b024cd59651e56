"""The events table as logs: one definition in SQL that Spark and the oracle share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.functions.tokens import tokens

_FIELDS = {
    "hostname": "concat('host-', CAST(user_id % 20 AS VARCHAR(20)))",
    "facility": "concat('local', CAST(event_id % 8 AS VARCHAR(20)))",
    "severity": """CASE WHEN event_type = 'error' THEN CASE WHEN value >= 200 THEN 'emerg' WHEN value >= 100 THEN 'crit' ELSE 'err' END
        WHEN event_type = 'signup' AND value >= 200 THEN 'alert'
        WHEN event_type = 'purchase' THEN CASE WHEN value >= 100 THEN 'warning' ELSE 'notice' END
        WHEN event_type = 'click' THEN 'debug' ELSE 'info' END""",
    "app_name": "CASE WHEN event_id % 10 = 0 THEN NULL ELSE event_type END",
    "process_id": "CAST(user_id AS VARCHAR(20))",
    "message": """CASE event_type WHEN 'error' THEN concat('connection refused by peer for user ', CAST(user_id AS VARCHAR(20)))
        WHEN 'purchase' THEN concat('restarted payment service for user ', CAST(user_id AS VARCHAR(20)))
        WHEN 'signup' THEN concat('Café session opened for user ', CAST(user_id AS VARCHAR(20)))
        WHEN 'click' THEN 'refused: connection dropped, disk full on /dev/sda'
        ELSE 'kernel panic: unable to mount root_fs' END""",
    "source_ip": "concat('10.0.', CAST(user_id % 4 AS VARCHAR(20)), '.', CAST(user_id % 50 AS VARCHAR(20)), ':514')",
}


def _select(timestamp: str, received_at: str, source: str) -> str:
    fields = _FIELDS | {"id": "event_id", "timestamp": timestamp, "received_at": received_at, "ts": "ts", "event_type": "event_type"}
    return "SELECT " + ", ".join(f'{sql} AS {name}' for name, sql in fields.items()) + f" FROM {source}"


#: The logs table in the oracle's SQL.
LOGS_SQL = _select("strftime(ts, '%Y-%m-%dT%H:%M:%S.%f+00:00')", "ts + to_seconds(event_id % 5)", "events")


def logs_view(spark: SparkSession, sf_dir: str, tokenized: bool = False) -> DataFrame:
    """The events of sf_dir as logs, with tokens of the message if asked."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    stamp = "concat(date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS\"), '+00:00')"
    received = "ts + make_dt_interval(0, 0, 0, CAST(event_id % 5 AS DECIMAL(18, 6)))"
    fields = _FIELDS | {"id": "event_id", "timestamp": stamp, "received_at": received, "ts": "ts", "event_type": "event_type"}
    logs = events.selectExpr(*(f"{sql} AS {name}" for name, sql in fields.items()))
    return logs.withColumn("tokens", tokens(F.col("message"))) if tokenized else logs
