from datetime import datetime

import pytest
from pyspark.sql import functions as F

from logloom.functions.tokens import tokens
from logloom.operators.lifecycle import Budget
from logloom.plans.service import LogEngine, number
from logloom.schema import InvalidInput


def logs(spark, *rows):
    """rows: id, time, host, severity, message."""
    df = spark.createDataFrame([(i, t, h, s, m) for i, t, h, s, m in rows], "id long, timestamp string, hostname string, severity string, message string")
    df = df.withColumns({"ts": F.to_timestamp("timestamp"), "received_at": F.to_timestamp("timestamp"), "source_ip": F.lit("127.0.0.1:514")})
    for c in ("facility", "app_name", "process_id"):
        df = df.withColumn(c, F.lit(None).cast("string"))
    return df.withColumn("tokens", tokens(F.col("message")))


@pytest.fixture()
def engine(spark):
    return LogEngine(logs(spark, (1, "2026-01-01T00:00:00Z", "host-a", "err", "disk full"), (2, "2026-01-01T00:01:00Z", "host-b", "warning", "connection established"), (3, "2026-01-01T00:02:00Z", "host-b", "info", "disk ok")))


def test_correlate_truncates_the_oldest(engine):
    got = engine.correlate(reference_time="2026-01-01T01:00:00+01:00", window_minutes=2, limit=1)
    assert (got.window_from, got.window_to) == ("2025-12-31T23:58:00+00:00", "2026-01-01T00:02:00+00:00")
    one = got.summary.first()
    assert (one.truncated, one.total_events, one.total_hosts) == (True, 1, 1)
    assert [r.hostname for r in got.hosts.collect()] == ["host-b"]


def test_correlate_limit_zero(engine):
    one = engine.correlate(reference_time="2026-01-01T00:00:00Z", limit=0).summary.first()
    assert (one.truncated, one.total_events) == (True, 0)


def test_search(engine):
    assert [r.id for r in engine.search(query="disk").collect()] == [3, 1]
    assert engine.search(severity="warn").count() == 0
    assert engine.search(limit=0).count() == 0
    assert [r.id for r in engine.search(**{"from": "2026-01-01T00:01:00Z"}).collect()] == [3, 2]
    assert "raw" not in engine.search().columns


def test_ties_go_to_the_larger_id(spark):
    same = [(i, "2026-01-01T00:00:00Z", "h", "info", "x") for i in (5, 9, 7)]
    assert [r.id for r in LogEngine(logs(spark, *same)).tail().collect()] == [9, 7, 5]


def test_errors_and_hosts(engine):
    assert [(r.hostname, r.severity, r["count"]) for r in engine.errors().collect()] == [("host-a", "err", 1), ("host-b", "warning", 1)]
    assert [(r.hostname, r.log_count) for r in engine.hosts().collect()] == [("host-b", 2), ("host-a", 1)]


def test_empty_table(spark, engine):
    none = LogEngine(engine.logs.where("false"))
    row = none.stats().first()
    assert (row.total_logs, row.oldest_log) == (0, None)
    assert none.search().count() == 0 and none.errors().count() == 0


def test_requests(engine):
    assert number("x", 7, 10, "n") == 7 and number(50, 7, 10, "n") == 10
    for call in (lambda: number(1 << 32, 1, 1, "n"), lambda: engine.correlate(), lambda: engine.run("nope"), lambda: engine.correlate(reference_time="2026-01-01T00:00:00Z", severity_min="loud")):
        with pytest.raises(InvalidInput):
            call()
    assert engine.health() and "search" in engine.run("help")


def test_budget_settings():
    b = Budget()
    assert b.triggered(2 << 30, None) and b.triggered(0, 64 << 20) and not b.triggered(0, 600 << 20)
    assert not b.recovered(0, 600 << 20) and b.recovered(0, 900 << 20)
    for wrong in ({"recovery_mb": 2000}, {"interval_secs": 4}, {"chunk": 0}, {"max_mb": 0}):
        with pytest.raises(InvalidInput):
            Budget(**wrong)


def test_plan_pushes_filters_down(spark, sf_dir):
    from logloom.operators.filters import filtered
    from logloom.sources.events import logs_view

    df = filtered(logs_view(spark, sf_dir), start=datetime(2024, 1, 10)).select("id")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts" in plan and "props" not in plan
