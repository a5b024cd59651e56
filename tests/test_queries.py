import duckdb
import pytest

import __spark_entry__ as entry
from logloom.plans import catalogue


@pytest.fixture(scope="session")
def oracle(sf_dir):
    con = duckdb.connect()
    for table in ("events", "documents"):
        con.sql(f"create view {table} as select * from '{sf_dir}/{table}.parquet'")
    return con


def plain(value):
    return round(value, 6) if isinstance(value, float) else value


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE))
def test_query_agrees_with_the_oracle(spark, sf_dir, oracle, name):
    got = catalogue.QUERIES[name](spark, sf_dir)
    want = oracle.sql(catalogue.ORACLE[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = lambda names, data: sorted(repr([plain(r[names.index(c)]) for c in columns]) for r in data)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(list(want.columns), want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).columns == ["hostname", "event_count", "event_ids"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
