"""Connected components of an edge table: each task contracts its edges, star rounds with Spark joins connect the rest."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.llm.common import checkpointed


#: So many edges (16 bytes each) a task reads.
EDGES_A_TASK = 500_000


def hung(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of edges (u, v) that are not the smallest of their component, and that smallest node for each."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b, label = at[: len(u)], at[len(u) :], np.arange(len(nodes))
    while True:
        high, low = np.maximum(label[a], label[b]), np.minimum(label[a], label[b])
        apart = high != low
        if not apart.any():
            break
        np.minimum.at(label, high[apart], low[apart])
        while (label[label] != label).any():
            label = label[label]
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[moved], nodes[label[moved]]


def contracted(edges: DataFrame) -> DataFrame:
    """Edges (u, v) with the components of edges; of each partition's, every node hangs on the smallest."""

    def contract(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [pdf.to_numpy(np.int64) for pdf in parts if len(pdf)]
        if held:
            yield pd.DataFrame(dict(zip("uv", hung(*np.concatenate(held).T))))

    return edges.select("u", "v").where("u <> v").mapInPandas(contract, "u long, v long")


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """node, component: the smallest node reachable from each node of edges (u, v), longs.

    Each task first hangs the nodes of its own edges on their smallest, up to EDGES_A_TASK a task. What is one task's then
    is done. A larger table goes on in rounds: large-star and small-star hang every node on the smallest neighbour until
    nothing changes. A round is joins and sums by node; hot nodes are pre-aggregated, and their join side is one that Spark
    can split. Each round is checkpointed. Edges from a node to itself, repeated and null ones add nothing.
    """
    now, before = checkpointed(contracted(edges)), None
    n = now.count()
    tasks = max(1, -(-n // EDGES_A_TASK))
    if n:
        now = checkpointed(contracted(now.coalesce(tasks)))
    for _ in range(max_rounds):
        mark = None if tasks == 1 else now.agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(u, v))").alias("x")).first()
        if mark == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        before = mark
        now = now.coalesce(tasks)
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = checkpointed(small.union(least.select("u", F.col("m").alias("v"))).distinct())
    raise RuntimeError("the components did not settle; raise max_rounds")
