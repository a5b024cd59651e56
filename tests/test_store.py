import json
from datetime import datetime

import pytest

from logloom.sources.hosts_file import load_hosts
from logloom.schema import InvalidInput
from logloom.streaming.ingest import ingest, parsed_syslog, read_containers, read_lines
from logloom.operators.lifecycle import Budget
from logloom.settings import Settings, load_settings
from logloom.streaming.store import LogStore, Metrics, WriteBlocked


def put(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(map(json.dumps, rows)))


def line(text, at):
    return {"value": text, "source_ip": "10.0.0.1:514", "received_at": at}


def test_stream_store_purge_and_budget(spark, tmp_path):
    landing, store = tmp_path / "in", LogStore(spark, str(tmp_path / "store"))
    put(landing, "a.json", [line("<34>Oct 11 22:14:15 h1 su: one", "2026-01-01T00:00:00Z"), line("<34>Oct 11 22:14:15 h2 su: two", "2026-01-02T00:00:00Z"), line("", "2026-01-02T00:00:00Z"), line("x" * 9000, "2026-01-02T00:00:00Z")])
    go = lambda: ingest(read_lines(spark, str(landing)), store, str(tmp_path / "cp")).awaitTermination()
    go()
    assert [(r.id, r.hostname) for r in store.logs().orderBy("id").collect()] == [(1, "h1"), (2, "h2")]
    put(landing, "b.json", [line("<34>Oct 11 22:14:15 h1 su: three", "2026-01-03T00:00:00Z")])
    go(), go()
    assert store.logs().count() == 3
    assert {r.hostname: r.log_count for r in store.hosts().collect()} == {"h1": 2, "h2": 1}
    assert not store.commit_batch(store.logs().limit(1), 1), "a replayed batch is left alone"
    assert store.purge(None) == 0 and store.purge(datetime(2026, 1, 2)) == 1
    assert {r.hostname: r.log_count for r in store.hosts().collect()} == {"h1": 2, "h2": 1}, "a purge leaves the registry"
    assert store.enforce_budget(150, chunk=1) == 1, "the older of the two rows left"
    assert {r.hostname: r.log_count for r in store.hosts().collect()} == {"h1": 2}, "only affected hosts are counted anew"
    store.vacuum()
    assert [r.message for r in store.logs().collect()] == ["three"]
    with pytest.raises(WriteBlocked):
        store.commit_batch(store.logs(), 99, blocked=True)


def container(text, at="2026-01-01T00:00:00Z"):
    return {"host_name": "h", "container_id": "c1", "name": "web", "stream": "stdout", "line": text, "received_at": at}


def test_container_checkpoints_tell_nanoseconds_apart(spark, tmp_path):
    landing, store = tmp_path / "in", LogStore(spark, str(tmp_path / "store"))
    go = lambda: ingest(read_containers(spark, str(landing)), store, str(tmp_path / "cp"), containers=True).awaitTermination()
    put(landing, "a.json", [container("2024-01-01T00:00:03.500000000Z a")])
    go()
    put(landing, "b.json", [container(f"2024-01-01T00:00:03.{n}Z b{n}") for n in ("123456789", "500000000", "500000001")])
    go()
    assert {r.message for r in store.logs().collect()} == {"a", "b500000001"}
    assert store.checkpoints().first().last_timestamp == "2024-01-01T00:00:03.500000001Z"


def test_two_streams_share_a_store(spark, tmp_path):
    store = LogStore(spark, str(tmp_path / "store"))
    put(tmp_path / "lines", "a.json", [line("<34>Oct 11 22:14:15 h1 su: one", "2026-01-01T00:00:00Z")])
    put(tmp_path / "containers", "a.json", [container("2024-01-01T00:00:03Z two")])
    runs = [ingest(read_lines(spark, str(tmp_path / "lines")), store, str(tmp_path / "cp1")), ingest(read_containers(spark, str(tmp_path / "containers")), store, str(tmp_path / "cp2"), containers=True)]
    for run in runs:
        run.awaitTermination()
    assert {(r.id, r.message) for r in store.logs().collect()} in ({(1, "one"), (2, "two")}, {(1, "two"), (2, "one")})
    assert {r.hostname: r.log_count for r in store.hosts().collect()} == {"h1": 1, "h": 1}
    assert store.checkpoints().count() == 1


def test_hosts_file(tmp_path):
    path = tmp_path / "hosts.toml"
    path.write_text('[[hosts]]\nname = "a"\nbase_url = "https://a:1"\n')
    assert load_hosts(str(path))[0].name == "a"
    path.write_text('[[hosts]]\nname = "a"\nbase_url = "http://a:1"\n')
    with pytest.raises(InvalidInput):
        load_hosts(str(path))


def stored(spark, folder, *rows):
    """A store with a batch of syslog lines (host, message, received_at)."""
    store = LogStore(spark, str(folder))
    lines = [(f"<34>1 {at:%Y-%m-%dT%H:%M:%SZ} {host} su - - - {text}", "a:1", at) for host, text, at in rows]
    store.commit_batch(parsed_syslog(spark.createDataFrame(lines, "value string, source_ip string, received_at timestamp")), 0)
    return store


def test_retention_goes_by_arrival(spark, tmp_path):
    store = stored(spark, tmp_path, ("a", "old", datetime(2020, 1, 1)), ("a", "new", datetime(2026, 1, 1)))
    assert store.purge(Settings(retention_days=0).cutoff()) == 0
    assert store.purge(Settings(retention_days=90).cutoff(datetime(2026, 2, 1))) == 1
    store.vacuum(grace_secs=-1, keep=1)
    assert len(list((tmp_path / "data").glob("*/day=*"))) == 1
    assert [r.message for r in store.logs().collect()] == ["new"]


def test_budget_by_size_and_by_free_space(spark, tmp_path):
    rows = ("gone", "oldest-" * 350_000, datetime(2026, 1, 1)), ("kept", "newest-" * 30_000, datetime(2026, 1, 2))
    store = stored(spark, tmp_path / "a", *rows)
    before = store.metrics()
    assert before.logical > 2_600_000 and before.physical > 0 and before.free > 0
    done = store.enforce(Budget(max_mb=3, recovery_mb=2, min_free_mb=0, recovery_free_mb=0, chunk=1))
    assert (done.deleted, done.write_blocked) == (1, False) and done.metrics.logical <= 2 << 20
    assert [(r.hostname, r.log_count) for r in store.hosts().collect()] == [("kept", 1)]

    store, mb = stored(spark, tmp_path / "b", *rows), 1 << 20
    short = iter([Metrics(5 * mb, 5 * mb, 766 * mb), Metrics(mb, mb, 900 * mb)])
    done = store.enforce(Budget(max_mb=0, recovery_mb=0, chunk=1), lambda: next(short))
    assert done.deleted == 1 and not done.write_blocked

    done = store.enforce(Budget(max_mb=0, recovery_mb=0, chunk=1), lambda: Metrics(mb, mb, 64 * mb))
    assert done.write_blocked and store.logs().count() == 0
    with pytest.raises(WriteBlocked):
        store.commit_batch(store.logs(), 5)
    assert not store.enforce(Budget(max_mb=0, recovery_mb=0), lambda: Metrics(mb, mb, 900 * mb)).write_blocked


def test_oversized_lines(spark, tmp_path):
    landing, store = tmp_path / "in", LogStore(spark, str(tmp_path / "store"))
    put(landing, "a.json", [line("é" * 100, "2026-01-01T00:00:00Z") | {"transport": t} for t in ("udp", "tcp")])
    ingest(read_lines(spark, str(landing), max_bytes=51), store, str(tmp_path / "cp")).awaitTermination()
    assert [r.message for r in store.logs().collect()] == ["é" * 25]


def test_old_versions_go_and_plans_do_not_grow(spark, tmp_path):
    store = stored(spark, tmp_path, ("a", "x", datetime(2026, 1, 1)))
    for k in range(22):
        store._commit(lambda base, k=k: {"next_id": 100 + k})
    assert len(list((tmp_path / "versions").glob("*.json"))) == 20 and store.state()["version"] == 23
    plan = store.logs()._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and ") Filter" not in plan


def test_settings(tmp_path):
    path = tmp_path / "s.toml"
    path.write_text("retention_days = 7\n[budget]\nmax_mb = 50\nrecovery_mb = 40\n")
    s = load_settings(str(path), {"LOGLOOM_RETENTION_DAYS": "9", "LOGLOOM_CHUNK": "10"})
    assert (s.retention_days, s.budget.max_mb, s.budget.chunk, s.max_message_bytes) == (9, 50, 10, 8192)
    path.write_text("nope = 1\n")
    for bad in (lambda: load_settings(str(path), {}), lambda: load_settings(None, {"LOGLOOM_CHUNK": "x"}), lambda: load_settings(None, {"LOGLOOM_RECOVERY_MB": "5000"})):
        with pytest.raises(InvalidInput):
            bad()
