"""The store's parts: two writers, late rows, pruning, merges, running totals, the budget, timed upkeep, an older format."""

import os
import subprocess
import sys
import threading
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from logloom.operators.filters import filtered, log_columns, newest
from logloom.operators.lifecycle import Budget, row_bytes
from logloom.plans.service import LogEngine, StoreEngine
from logloom.schema import LOGS
from logloom.settings import Settings
from logloom.streaming.ingest import parsed_syslog
from logloom.streaming import parts
from logloom.streaming.parts import SORTED, within
from logloom.streaming.store import LogStore, Metrics
from logloom.streaming.upkeep import Upkeep, keep_up

DAY0 = datetime(2026, 1, 1)


def lines(spark, rows):
    """Parsed rows of (host, message, received_at, time or None)."""
    data = [(f"<3{n % 8}>1 {(at if t is None else t):%Y-%m-%dT%H:%M:%S.%fZ} {host} su - - - {text}", f"10.0.0.{n % 3}:514", at) for n, (host, text, at, t) in enumerate(rows)]
    return parsed_syslog(spark.createDataFrame(data, "value string, source_ip string, received_at timestamp"))


def filled(spark, folder, batches=4, days=3, each=10):
    """A store of some batches, each with rows of one day, and rows whose clock is off."""
    store = LogStore(spark, str(folder))
    for b in range(batches):
        day = DAY0 + timedelta(days=b % days)
        odd = [("odd", "clock runs late", day, DAY0 + timedelta(days=1, hours=b))]
        store.commit_batch(lines(spark, [(f"h{k % 3}", f"disk message {k} of {b}", day + timedelta(minutes=k), None) for k in range(each)] + odd), b)
    return store


def texts(df):
    return sorted((r.hostname, r.message, r.received_at) for r in df.collect())


OTHER = """
import sys
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
sys.path.insert(0, sys.argv[2])
from test_parts import *
store = LogStore(spark, sys.argv[1])
for b in range(6):
    store.commit_batch(lines(spark, [("other", f"b{b}", DAY0, None)]), b, stream="other")
store.purge(DAY0 - timedelta(days=9)), store.compact()
"""


def test_two_processes_lose_nothing(spark, tmp_path):
    here = os.path.dirname(__file__)
    env = os.environ | {"PYTHONPATH": f"{os.path.dirname(here)}:{os.environ.get('PYTHONPATH', '')}"}
    other = subprocess.Popen([sys.executable, "-c", OTHER, str(tmp_path), here], env=env, stderr=subprocess.DEVNULL)
    store, b = LogStore(spark, str(tmp_path)), 0
    while other.poll() is None or b < 6:
        store.commit_batch(lines(spark, [("here", f"b{b}", DAY0, None)] * 2), b, stream="here")
        store.compact()
        b += 1
    assert other.returncode == 0
    assert {r.hostname: r.log_count for r in store.hosts().collect()} == {"here": 2 * b, "other": 6}
    rows = store.logs().collect()
    assert sorted(r.id for r in rows) == list(range(1, 2 * b + 7)), "each id once, none left out"
    assert store.state()["batches"] == {"here": b - 1, "other": 5}


def test_a_writer_who_is_late_does_its_work_again(spark, tmp_path):
    a, b = (LogStore(spark, str(tmp_path)) for _ in range(2))
    between, added = threading.Event(), a._added

    def interrupted(*given):
        changes = added(*given)
        if not between.is_set():
            between.set()
            b.commit_batch(lines(spark, [("b", "x", DAY0, None)] * 3), 0, stream="b")
        return changes

    a._added = interrupted
    assert a.commit_batch(lines(spark, [("a", "x", DAY0, None)] * 4), 0, stream="a")
    assert a.state()["version"] == 2 and {r.hostname: r.log_count for r in b.hosts().collect()} == {"a": 4, "b": 3}
    assert sorted((r.id, r.hostname) for r in b.logs().collect()) == [(1, "b"), (2, "b"), (3, "b"), (4, "a"), (5, "a"), (6, "a"), (7, "a")]
    a.vacuum(grace_secs=-1)
    assert b.logs().count() == 7, "what the first try wrote is gone, what counts is not"


def test_late_rows_count_and_last_seen_never_goes_back(spark, tmp_path):
    store = filled(spark, tmp_path, 3)
    assert store.purge(DAY0 + timedelta(days=1)) == 11
    store.commit_batch(lines(spark, [("h0", "late", DAY0 - timedelta(days=9), None)] * 5), 3)
    assert store.logs().where("message = 'late'").count() == 5
    h0 = {r.hostname: r for r in store.hosts().collect()}["h0"]
    assert h0.log_count == 17 and h0.last_seen == DAY0 + timedelta(days=2, minutes=9) and h0.first_seen == DAY0 - timedelta(days=9)
    assert store.purge(DAY0 + timedelta(days=1, minutes=3)) == 9 and store.logs().count() == 18, "late rows go with the next purge"


def test_purge_reads_only_the_parts_it_cuts(spark, tmp_path):
    store = filled(spark, tmp_path)
    before, want = store.state()["parts"], texts(store.logs().where(F.col("received_at") >= F.lit(DAY0 + timedelta(days=1, minutes=5))))
    store.purge(DAY0 + timedelta(days=1, minutes=5))
    assert texts(store.logs()) == want
    kept = [p for p in store.state()["parts"] if p in before]
    assert len(kept) == 1 and len(store.state()["parts"]) == 2


@pytest.mark.parametrize("merged", [False, True])
def test_requests_over_the_store_equal_those_over_all_rows(spark, tmp_path, merged):
    store = filled(spark, tmp_path, 9, 5)
    if merged:
        assert store.compact(rows=7) == 9
    all_rows, engine = LogEngine(store.logs(), store.hosts()), StoreEngine(store)
    day = lambda d: f"2026-01-0{d}T00:03:00Z"
    asked = [("tail", {"n": 3}), ("tail", {"n": 500}), ("tail", {"hostname": "odd", "n": 2}), ("search", {"query": '"clock run"', "limit": 4}), ("search", {"from": day(2), "to": day(3)}), ("search", {"hostname": "h1", "severity": "info", "limit": 1}), ("search", {"limit": 0}), ("errors", {"from": day(3)}), ("search", {"hostname": "nobody"})]
    for action, params in asked:
        got, want = engine.run(action, **params).collect(), all_rows.run(action, **params).collect()
        assert got == want, (action, params)
    around = engine.correlate(reference_time="2026-01-02T00:05:00Z", severity_min="debug", limit=5)
    assert around.events.collect() == all_rows.correlate(reference_time="2026-01-02T00:05:00Z", severity_min="debug", limit=5).events.collect()
    assert around.summary.first() == (True, 5, 3)


def test_unneeded_parts_are_not_read(spark, tmp_path):
    store = LogStore(spark, str(tmp_path))
    for b in range(8):
        store.commit_batch(lines(spark, [("h", f"m{k}", DAY0 + timedelta(days=b, minutes=k), None) for k in range(20)]), b)
    engine, folder = StoreEngine(store), lambda f: f.rpartition("/")[0]
    read = lambda df: {folder(f) for f in df.inputFiles()}
    assert len(read(engine.tail(n=20))) == 1 and len(read(engine.tail(n=21))) == 4 and len(read(engine.search(hostname="h", limit=5))) == 1
    assert len(read(engine.search(**{"from": "2026-01-03T00:00:00Z", "to": "2026-01-04T23:00:00Z"}))) <= 2
    assert len(read(engine.correlate(reference_time="2026-01-05T00:00:00Z").events)) == 1
    assert len(within(engine.parts, DAY0.replace(tzinfo=UTC), DAY0.replace(tzinfo=UTC))) == 1


def test_merges_keep_rows_and_readers(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(parts, "FAN_IN", 5)
    store = filled(spark, tmp_path, 6, 1, 20)
    before, want = store.logs(), texts(store.logs())
    assert store.compact(today=0) == 6, "a running day: parts of one level are merged by number"
    assert [p.level for p in store.state()["parts"]] == [1]
    assert store.compact(today=0) == 0
    assert store.compact(rows=50) == 1, "a finished day: sorted slices"
    found = sorted(store.state()["parts"], key=lambda p: p.first_ts)
    assert {p.level for p in found} == {SORTED} and len(found) == 3 and all(a.last_ts <= b.first_ts for a, b in zip(found, found[1:], strict=False))
    assert texts(store.logs()) == want and texts(before) == want, "a reader under way still finds its parts"
    assert store.compact() == 0
    store.vacuum(grace_secs=-1, keep=1)
    assert texts(store.logs()) == want and len(list((tmp_path / "data").glob("*/day=*/slice=*"))) == 3


def test_running_totals_equal_a_recount(spark, tmp_path):
    store = filled(spark, tmp_path, 5)
    store.commit_batch(lines(spark, [("again", "x", DAY0, None)]), 4), "a replay"
    store.purge(DAY0 + timedelta(minutes=4)), store.compact(rows=9), store.enforce_budget(2_000, 3)
    logs = store.logs()
    want = logs.agg(F.count("*"), F.sum(row_bytes(logs)), F.min("timestamp"), F.max("timestamp")).first()
    assert (sum(p.n for p in store.state()["parts"]), store.metrics().logical) == want[:2]
    stats = StoreEngine(store).stats()
    assert stats.first() == LogEngine(logs, store.hosts()).stats().first() and not any("data/" in f for f in stats.inputFiles())


def test_budget_goes_on_until_it_holds_and_blocks_only_when_nothing_is_left(spark, tmp_path):
    store, mb = filled(spark, tmp_path, 6), 1 << 20
    by_space = Budget(max_mb=0, recovery_mb=0, chunk=5)

    def slowly():
        """Free space that comes back only as rows go."""
        free = 800 if sum(p.n for p in store.state()["parts"]) <= 40 else 700
        return Metrics(100, 100, free * mb)

    done = store.enforce(by_space, slowly)
    assert not done.write_blocked and done.deleted == 66 - sum(p.n for p in store.state()["parts"]) == 30
    kept = texts(store.logs())
    assert store.logs().count() and min(k[2] for k in kept) >= DAY0, "the oldest went"
    newest_gone = 66 - done.deleted
    assert store.logs().count() == newest_gone
    done = store.enforce(by_space, lambda: Metrics(100, 100, 100 * mb))
    assert done.write_blocked and store.logs().count() == 0 and store.hosts().count() == 0
    assert not store.enforce(by_space, lambda: Metrics(0, 0, 800 * mb)).write_blocked


def test_budget_lets_the_oldest_chunks_go_whatever_the_parts(spark, tmp_path):
    store = filled(spark, tmp_path, 7)
    store.compact(rows=6)
    rows = sorted(store.logs().withColumn("size", row_bytes(store.logs())).collect(), key=lambda r: (r.received_at, r.id))
    for most, chunk in ((5_000, 1), (4_000, 7), (3_000, 4), (10, 3)):
        total, gone = sum(r["size"] for r in rows), 0
        while total > most:
            total, gone = total - sum(r["size"] for r in rows[gone : gone + chunk]), min(gone + chunk, len(rows))
        assert store.enforce_budget(most, chunk) == gone
        rows = rows[gone:]
        assert sorted(r.id for r in store.logs().collect()) == sorted(r.id for r in rows)
        assert {(r.hostname, r.log_count) for r in store.hosts().collect()} == {(h, sum(r.hostname == h for r in rows)) for h in {r.hostname for r in rows}}


def test_timed_upkeep(spark, tmp_path):
    store, now = filled(spark, tmp_path / "s", 2), [0.0]
    upkeep = Upkeep(store, Settings(retention_days=1, budget=Budget(interval_secs=60)), lambda: now[0])
    assert upkeep.run().keys() == {"deleted", "write_blocked"}, "the budget at the start"
    assert upkeep.run() == {}
    now[0] = 61
    assert upkeep.run()["merged"] == 2
    now[0] = 3601
    assert upkeep.run()["purged"] == 22 and store.logs().count() == 0
    stream = keep_up(LogStore(spark, str(tmp_path / "s")), Settings(), str(tmp_path / "cp"), every="1 second")
    try:
        stream.awaitTermination(4)
        assert stream.isActive and stream.lastProgress is not None
    finally:
        stream.stop()


def test_a_store_of_the_older_format_opens(spark, tmp_path):
    new, old = filled(spark, tmp_path / "new", 3), tmp_path / "old"
    rows = new.logs().withColumns({"received_date": F.to_date("received_at"), "stream": F.lit("syslog"), "batch": (F.col("id") / 11.1).cast("long")})
    late = rows.limit(2).withColumn("batch", F.lit(9).cast("long"))
    rows.unionByName(late).write.partitionBy("received_date", "stream", "batch").parquet(f"{old}/logs")
    new.hosts().write.parquet(f"{old}/hosts/v=4"), new.checkpoints().write.parquet(f"{old}/checkpoints/v=4")
    state = "format int, version long, next_id long, batches map<string,long>, first_at timestamp, first_id long, write_blocked boolean"
    bound = DAY0 + timedelta(days=1, minutes=3)
    spark.createDataFrame([(2, 4, 34, {"syslog": 2}, bound, 0, False)], state).write.parquet(f"{old}/state/v=4")
    store = LogStore(spark, str(old))
    want = texts(new.logs().where(F.col("received_at") >= F.lit(bound)))
    assert texts(store.logs()) == want and len(want) == 18
    assert store.hosts().exceptAll(new.hosts()).count() == 0 and store.state()["format"] == 3
    assert not store.commit_batch(new.logs().limit(1), 2) and store.commit_batch(lines(spark, [("h", "more", DAY0, None)]), 3)
    assert sorted(r.id for r in store.logs().collect())[-1] == 34
    store.compact()
    store.vacuum(grace_secs=-1, keep=1)
    assert store.logs().count() == 19 and not list(old.glob("logs/*/*/*/*.parquet"))
    spark.createDataFrame([(1, 5, 34, {}, None, 0, False)], state).write.parquet(f"{tmp_path}/older/state/v=5")
    with pytest.raises(RuntimeError, match="format 1"):
        LogStore(spark, f"{tmp_path}/older").state()


def test_columns_of_the_logs(spark, tmp_path):
    store = filled(spark, tmp_path, 1)
    assert store.logs().columns == LOGS.fieldNames() and log_columns(newest(filtered(store.logs(), query="disk"), 3)).count() == 3
