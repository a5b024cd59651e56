"""Components against a plain union-find, also of more edges than one task reads."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from logloom.llm import components


def plain(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for u, v in edges:
        if u is not None and v is not None and u != v:
            x, y = sorted((find(u), find(v)))
            root[y] = x
    return {x: find(x) for x in root}


@pytest.mark.parametrize("edges_a_task", [1_000_000, 40])
def test_components_of_chains_and_stars(spark, monkeypatch, edges_a_task):
    monkeypatch.setattr(components, "EDGES_A_TASK", edges_a_task)
    r = np.random.default_rng(5)
    names = r.permutation(2000).astype(np.int64) - 1000
    pairs = [(i, i + 1) for i in range(0, 300)] + [(400, i) for i in range(401, 700)] + [tuple(x) for x in r.integers(800, 1400, (400, 2)).tolist()]
    edges = [(int(names[a]), int(names[b])) for a, b in pairs] + [(5, 5), (None, 3), (7, None), (-(1 << 63), (1 << 63) - 1)]
    got = components.connected_components(spark.createDataFrame(edges + edges[:50], "u long, v long").repartition(6)).collect()
    assert len(got) == len({x.node for x in got}) and {x.node: x.component for x in got} == plain(edges)


def test_an_empty_table_has_no_components(spark):
    assert components.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_a_table_of_one_task_needs_no_shuffle(spark):
    found = components.connected_components(spark.range(1000).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v")))
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString() and found.where("component = 0").count() == 1001
