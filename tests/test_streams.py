"""Streams with state: containers followed, checkpoints by container, the ingest summary."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F
from test_store import container, line, put

from logloom.operators.aggregates import latest_states, sender_counts, summary_of
from logloom.streaming.containers import EVENTS_SCHEMA, follow
from logloom.streaming.ingest import ingest, parsed_syslog, read_containers, read_lines, summarize
from logloom.streaming.store import LogStore

DAY0 = datetime(2026, 1, 1)


def event(second, action, name="web", container_id="c1", host="h"):
    return {"host_name": host, "container_id": container_id, "action": action, "name": name, "at": (DAY0 + timedelta(seconds=second)).isoformat() + "Z"}


def test_containers_are_followed(spark, tmp_path):
    batches, landing = {}, tmp_path / "in"
    landing.mkdir()
    events = spark.readStream.schema(EVENTS_SCHEMA).json(str(landing))

    def go(name, *rows):
        put(landing, name, list(rows))
        follow(events, lambda df, n: batches.update({n: df.collect()}), str(tmp_path / "cp")).awaitTermination()
        return [((r.at - DAY0).seconds, r.container_id, r.state, r.name) for n in sorted(batches) for r in sorted(batches[n], key=lambda r: (r.container_id, r.at, r.state == "attached"))]

    first = [event(1, "start"), event(2, "start"), event(3, "exec"), event(1, "rename", "old", "c2"), event(4, "start", container_id=None), event(5, "stop", container_id="c3")]
    assert go("a.json", *first) == (want := [(1, "c1", "attached", "web"), (1, "c2", "attached", "old")])
    want += [(6, "c1", "detached", "web"), (6, "c1", "attached", "api"), (8, "c2", "detached", "old")]
    lookback = [event(1, "start"), event(1, "rename", "old", "c2")]
    assert go("b.json", event(6, "rename", "api"), event(9, "rename", "new", "c2"), event(8, "die", container_id="c2"), *lookback) == want
    want += [(20, "c1", "detached", "api"), (21, "c1", "attached", "api"), (30, "c2", "attached", "again")]
    assert go("c.json", event(21, "restart", None), event(20, "die"), event(20, "stop"), event(30, "start", "again", "c2"), *first) == want, "a restart keeps the state"
    states = latest_states(spark.createDataFrame([r for n in batches for r in batches[n]]))
    assert {(r.container_id, r.state) for r in states.collect()} == {("c1", "attached"), ("c2", "attached")}


def test_checkpoints_by_container_in_the_stream(spark, tmp_path):
    landing, stores = tmp_path / "in", {}
    for n, texts in enumerate((["03.5 a", "04 b"], ["03.5 c", "04.000000001 d", "02 e", "09 f"], ["09 g", "unreadable", "10 h", "10 i"])):
        put(landing, f"{n}.json", [container(f"2024-01-01T00:00:{t.partition(' ')[0]}Z {t[-1]}" if t[0].isdigit() else t) for t in texts] + [container(f"2024-01-01T00:00:0{n}Z x{n}") | {"container_id": "c2"}])
        for kind, ttl in (("table", None), ("state", 86_400_000)):
            stores[kind] = LogStore(spark, str(tmp_path / kind))
            ingest(read_containers(spark, str(landing)), stores[kind], str(tmp_path / f"cp-{kind}"), containers=True, ttl_ms=ttl).awaitTermination()
    got = {kind: sorted((r.message, r.process_id) for r in store.logs().collect()) for kind, store in stores.items()}
    assert got["state"] == got["table"] and {m for m, _ in got["state"]} >= {"a", "b", "d", "f", "h", "i", "x0", "x1", "x2"}
    assert stores["state"].checkpoints().count() == 0 and stores["table"].checkpoints().count() == 2


def test_ingest_summary_of_a_stream_equals_that_of_a_table(spark, tmp_path):
    landing, got = tmp_path / "in", []
    rows = lambda *s: [line(f"<34>1 2026-01-01T00:00:00Z h{k % 3} su - - - {k}", (DAY0 + timedelta(seconds=t)).isoformat() + "Z") | {"source_ip": f"10.0.0.{k % 2}:514"} for k, t in enumerate(s)]
    go = lambda: summarize(parsed_syslog(read_lines(spark, str(landing))), lambda df: got.extend(df.collect()), str(tmp_path / "cp")).awaitTermination()
    table = lambda: parsed_syslog(spark.read.schema("value string, source_ip string, received_at timestamp").json(str(landing)))
    put(landing, "a.json", rows(*range(0, 200, 7)))
    go()
    seen = table().collect()
    put(landing, "b.json", rows(1, 2, 3, 190, 200, 500))
    go()
    once = table().where(F.col("received_at") >= F.lit(DAY0 + timedelta(seconds=120))).unionByName(spark.createDataFrame([r for r in seen if r.received_at < DAY0 + timedelta(seconds=120)], table().schema))
    want = [r for r in summary_of(sender_counts(once)).collect() if r.window_start < DAY0 + timedelta(seconds=440)]
    assert sorted(got) == sorted(want) and len(got) == 4 and got[0].top.count("@") == 5, "rows later than a minute after their window are not counted"
