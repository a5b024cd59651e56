"""Searches by the inverted index against the conditions on all rows."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F
from test_fulltext import WORDS, _expression
from test_parts import lines

from logloom.functions.match import search
from logloom.plans.service import LogEngine, StoreEngine
from logloom.streaming import postings
from logloom.streaming.postings import candidates
from logloom.streaming.store import LogStore

DAY0 = datetime(2026, 1, 1)


def test_what_a_row_must_have(spark):
    needs = lambda q: {tuple(sorted(a)) for a in search(F.col("tokens"), q).needs}
    assert needs("disks AND (kernel OR panic*)") == {(("disk", False), ("kernel", False)), (("disk", False), ("panic", True))}
    assert needs('"connection refused" NOT disk') == {(("connect", False), ("refus", False))}
    assert needs('""') == set() and needs('- message : disk') == set() and needs('"" OR NEAR(a b)') == {(("a", False), ("b", False))}
    assert len(needs("(a OR b) AND (c OR d) AND (e OR f) AND (g OR h)")) <= 64


def test_searches_equal_those_over_all_rows(spark, tmp_path, monkeypatch):
    r, store = random.Random(7), LogStore(spark, str(tmp_path))
    text = lambda n: " ".join(r.choice(WORDS) if r.random() < 0.7 else f"rare{r.randint(0, 60)}" for _ in range(r.randint(0, 6)))
    for b in range(3):
        store.commit_batch(lines(spark, [(f"h{k % 3}", text(k), DAY0 + timedelta(days=b, minutes=k), None) for k in range(100)]), b)
    store.compact(rows=50)
    store.commit_batch(lines(spark, [("h", text(k), DAY0 + timedelta(days=9, minutes=k), None) for k in range(20)]), 3)
    assert len([p for p in store.state()["parts"] if p.index]) == 6 and len(store.state()["parts"]) == 7
    all_rows, engine = LogEngine(store.logs().cache(), store.hosts()), StoreEngine(store)
    asked = sorted({_expression(r) for _ in range(12)}) + ["rare7", "rare1 OR rare2", "rare3 AND disk", "rare4*", '"" OR rare5', "rare999", "disk NOT rare8", "rare9 rare10 OR kernel rare11"]
    for n, q in enumerate(asked):
        monkeypatch.setattr(postings, "FEW_IDS", 1000 if n % 2 else 0)
        got, want = engine.search(query=q, limit=1000).collect(), all_rows.search(query=q, limit=1000).collect()
        assert got == want, q
    first = engine.correlate(reference_time="2026-01-02T00:20:00Z", window_minutes=60, severity_min="debug", query="rare7 OR disk").events.collect()
    assert first == all_rows.correlate(reference_time="2026-01-02T00:20:00Z", window_minutes=60, severity_min="debug", query="rare7 OR disk").events.collect()


def test_only_parts_that_hit_are_read(spark, tmp_path):
    store = LogStore(spark, str(tmp_path))
    for b in range(4):
        store.commit_batch(lines(spark, [("h", "needle in it" if b == 2 and k == 5 else "hay of all kinds", DAY0 + timedelta(days=b, minutes=k), None) for k in range(50)]), b)
    store.compact()
    parts = store.state()["parts"]
    read = lambda q: {f.rpartition("/")[0] for f in candidates(store, parts, q).inputFiles()}
    assert len(read("needle")) == 1 and len(read("hay")) == 4 and len(read("needle AND hay")) == 1 and len(read("pin OR needles")) == 1 and not read("pin")
    assert "id" in candidates(store, parts, "needle")._jdf.queryExecution().executedPlan().toString().partition("PushedFilters")[2][:40], "the rows are found by id in the scan"
