"""Rows that one task of a store sorts stay bounded, whatever the size of a batch or a day."""

from pyspark.sql import functions as F

from logloom.plans.catalogue import _store
from logloom.streaming import store as stores
from logloom.streaming.parts import SORTED, Part, to_merge


def test_slices_of_a_large_day_are_not_merged_again():
    part = lambda k, n: Part(f"p{k}", 5, n, n, n, 0, 1, 0, 1, "", "", SORTED)
    assert to_merge([part(k, 90) for k in range(60)], 9, 100) == []
    assert len(to_merge([part(k, 40) for k in range(60)], 9, 100)) == 1


def test_a_large_batch_is_dealt_out_before_it_is_written(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(stores, "PART_ROWS", 100)
    store, batches = _store(spark, sf_dir)
    assert store.commit_batch(batches[0].coalesce(1), 0)
    logs = store.logs()
    most = logs.groupBy(F.input_file_name()).count().agg(F.max("count")).first()[0]
    assert most <= 200 and logs.select("id").distinct().count() == logs.count() == batches[0].count()
