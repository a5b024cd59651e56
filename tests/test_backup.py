"""Backups while streams write, restoring one, an emptied store."""

from datetime import timedelta

import pytest
from test_parts import DAY0, filled, lines, texts

from logloom.plans.service import StoreEngine
from logloom.streaming.backup import backup, prune, reset, restore
from logloom.streaming.store import LogStore


def rows(df):
    return sorted(map(str, df.collect()))


def folders(root):
    return {p.name for p in (root / "data").iterdir()}


def same(a: LogStore, b: LogStore):
    assert rows(a.logs()) == rows(b.logs()) and rows(a.hosts()) == rows(b.hosts()) and rows(a.checkpoints()) == rows(b.checkpoints())


def test_a_backup_is_a_store_and_copies_only_new_parts(spark, tmp_path):
    store, saved = filled(spark, tmp_path / "live store=1 %41", 5), tmp_path / "saved è"
    store.compact(rows=9)
    assert any(p.index for p in store.state()["parts"])
    store.commit_batch(lines(spark, [("late", "not merged", DAY0 + timedelta(days=1), None)]), 5)
    backup(store, str(saved))
    copy, first = LogStore(spark, str(saved)), folders(saved)
    same(store, copy)
    assert [(p.n, p.bytes, p.first_ts, bool(p.index)) for p in copy.state()["parts"]] == [(p.n, p.bytes, p.first_ts, bool(p.index)) for p in store.state()["parts"]]
    for asked in ({"query": "disk", "limit": 7}, {"query": '"clock run" NOT disk'}, {"query": "merged", "hostname": "late"}, {"limit": 3}):
        assert rows(StoreEngine(copy).search(**asked)) == rows(StoreEngine(store).search(**asked)), asked
    backup(store, str(saved))
    assert folders(saved) == first, "nothing new, nothing written"
    store.commit_batch(lines(spark, [("new", "x", DAY0 + timedelta(days=2), None)] * 3), 6)
    store.purge(DAY0 + timedelta(hours=1))
    backup(store, str(saved))
    same(store, copy)
    assert len(folders(saved) - first) == 1
    assert len(copy.at(2)["parts"]) > len(copy.state()["parts"]), "the earlier backup is still there"
    store.compact(rows=1_000)
    backup(store, str(saved))
    same(store, copy)
    assert all(p.index for p in copy.state()["parts"])


def test_a_restored_store_goes_on(spark, tmp_path):
    store, saved = filled(spark, tmp_path / "s", 3), str(tmp_path / "saved")
    store.compact()
    backup(store, saved)
    want, before = texts(store.logs()), store.logs()
    store.commit_batch(lines(spark, [("new", "after it", DAY0, None)] * 4), 3)
    backup(store, saved)
    store.purge(DAY0 + timedelta(days=2))
    assert restore(store, saved, 1) == 33 and texts(store.logs()) == want == texts(before)
    assert {r.hostname for r in store.hosts().collect()} == {"h0", "h1", "h2", "odd"}
    assert not store.commit_batch(lines(spark, [("again", "x", DAY0, None)]), 2), "a batch that the backup has"
    assert store.commit_batch(lines(spark, [("new", "after it", DAY0, None)] * 4), 3), "one that it has not"
    assert sorted(r.id for r in store.logs().collect()) == [*range(1, 34), *range(38, 42)], "no id is given twice"
    assert StoreEngine(store).search(query="disk").count() == 30
    store.vacuum(grace_secs=-1, keep=1)
    assert restore(store, saved) == 37 and LogStore(spark, str(tmp_path / "s")).logs().count() == 37
    with pytest.raises(FileNotFoundError):
        restore(store, str(tmp_path / "nowhere"))


def test_reset_keeps_a_backup_of_all(spark, tmp_path, monkeypatch):
    store, saved, tries = filled(spark, tmp_path / "s", 2), str(tmp_path / "saved"), []

    def interrupted(*given):
        state = backup(*given)
        if not tries:
            LogStore(spark, str(tmp_path / "s")).commit_batch(lines(spark, [("between", "x", DAY0, None)]), 2)
        tries.append(state["version"])
        return state

    monkeypatch.setattr("logloom.streaming.backup.backup", interrupted)
    assert reset(store, saved) == 23 and len(tries) == 2
    assert store.logs().count() == 0 and store.hosts().count() == 0 and store.metrics().logical == 0
    assert LogStore(spark, saved).logs().where("hostname = 'between'").count() == 1
    assert not store.commit_batch(lines(spark, [("again", "x", DAY0, None)]), 2)
    assert restore(store, saved) == 23


def test_old_backups_go_and_an_empty_store(spark, tmp_path):
    empty, saved = LogStore(spark, str(tmp_path / "e")), tmp_path / "saved"
    assert backup(empty, str(saved))["parts"] == [] and LogStore(spark, str(saved)).logs().count() == 0
    assert restore(empty, str(saved)) == 0 and reset(LogStore(spark, str(tmp_path / "none")), str(tmp_path / "x")) == 0
    store, target = filled(spark, tmp_path / "s", 2), LogStore(spark, str(saved))
    backup(store, str(saved))
    store.purge(DAY0 + timedelta(days=1))
    backup(store, str(saved), keep_secs=-1)
    assert list(target.files.children("versions")) == ["3.json"]
    prune(target, keep_secs=-1), target.vacuum(grace_secs=-1, keep=1)
    same(store, target)
    assert len(target.state()["parts"]) == 1
