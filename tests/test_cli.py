import json
from datetime import datetime

from logloom.__main__ import main, parameters
from logloom.streaming.ingest import parsed_syslog
from logloom.streaming.store import LogStore


def test_requests_over_a_store(spark, tmp_path, capsys):
    store = LogStore(spark, str(tmp_path))
    lines = spark.createDataFrame([("<34>1 2026-01-01T00:00:00Z h1 su - - - disk full", "a:1", datetime(2026, 1, 1))], "value string, source_ip string, received_at timestamp")
    store.commit_batch(parsed_syslog(lines), 0)
    assert main([str(tmp_path), "search", "query=disk", "limit=5"]) == 0
    assert json.loads(capsys.readouterr().out)["hostname"] == "h1"
    assert main([str(tmp_path), "correlate", "reference_time=2026-01-01T00:00:00Z"]) == 0
    assert len(capsys.readouterr().out.splitlines()) == 3
    assert main([str(tmp_path), "stats"]) == 0
    stats = json.loads(capsys.readouterr().out)
    assert stats["total_hosts"] == 1 and stats["max_db_size_mb"] == 1024 and stats["write_blocked"] is False and len(stats) == 11
    saved = f"{tmp_path}-saved"
    assert main([str(tmp_path), "backup", f"to={saved}"]) == 0 and main([str(tmp_path), "reset", f"to={saved}"]) == 0 and main([str(tmp_path), "restore", f"from={saved}", "version=1"]) == 0
    assert [json.loads(x) for x in capsys.readouterr().out.splitlines()] == [{"backed_up": 1}, {"deleted": 1}, {"restored": 1}]
    assert main([str(tmp_path), "backup"]) == 1 and main([str(tmp_path), "restore", "from=x", "to=y"]) == 1
    assert main([str(tmp_path), "maintain"]) == 0
    assert json.loads(capsys.readouterr().out) == {"purged": 1, "deleted": 0, "write_blocked": False, "merged": 0}
    assert main([str(tmp_path), "correlate"]) == 1 and main(["x", "nope"]) == 2
    assert parameters(["a=1", "b=x=y"]) == {"a": 1, "b": "x=y"}
