"""Approximate nearest neighbours by inner product, with collision-counting hashing.

Vectors are scaled by the largest norm and get one more coordinate, so that all have norm 1 and the nearest by distance
to a query is the one of the largest inner product. Each of `lines` random lines gives a number for each vector; a block
of vectors keeps these numbers as one sorted array a line. A query takes the `windows` lines on which it lies furthest
out: there a near vector lies far out too, and most others do not. Its own numbers centre a window on each of these
lines. Virtual rehashing widens all windows level by level, and each vector counts the windows that it has come into.
Vectors whose count reaches the collision threshold are verified by exact inner products in double precision, at the
first level at which `enough` of a block have been.

Blocks of vectors and blocks of queries meet by a join on numbered copies of the query blocks, so that each task holds
one block of either. The best of each block are ranked by query at the end. `enough` is a number for a block, not a share
of it, so the verified part falls as the table grows, to 4 % from a few blocks on. Vectors of different lengths have no
inner product and never meet.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logloom.llm.common import checkpointed


#: Of a small block, one vector in so many is verified (four times the wanted ones at least) before the windows stop to widen.
SHARE = 3


def usable(vectors: DataFrame) -> DataFrame:
    """Rows whose vector is neither null nor zero and has only finite components."""
    x = F.col("embedding")
    finite = F.forall(x, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False)))
    return vectors.where(x.isNotNull() & F.col("vec_id").isNotNull()).where(finite & F.exists(x, lambda v: v != 0))


class BlockIndex:
    """Sorted projections of one block of vectors (norm 1) on unit lines, one line's array after the other's.

    A line's numbers lie in -1..1; adding 4 times the line's number keeps the lines apart in one sorted array.
    """

    def __init__(self, unit: np.ndarray, lines: np.ndarray, ids: np.ndarray):
        self.lines, self.n = lines, len(unit)
        # Vectors that share an id count once towards `enough`.
        self.ids = ids if len(np.unique(ids)) < len(ids) else None
        self.order = np.empty((len(lines), self.n), np.int32)
        self.at = np.empty((len(lines), self.n))
        for j, line in enumerate(lines):
            at = unit @ line
            self.order[j] = np.argsort(at, kind="stable")
            self.at[j] = at[self.order[j]] + 4 * j
        self.order, self.at = self.order.ravel(), self.at.ravel()

    def candidates(self, query: np.ndarray, windows: int, threshold: int, enough: int, growth: float = 1.08) -> np.ndarray:
        """Numbers of the vectors whose collisions reach the threshold, at the first level at which `enough` do."""
        at = self.lines @ query
        out = np.argsort(-np.abs(at), kind="stable")[:windows]
        centre = at[out] + 4.0 * out
        # A line's numbers deviate by about 1 / sqrt(length), so the first window is about as wide as that.
        reach = 1.2 / np.sqrt(self.lines.shape[1])
        count = np.zeros(self.n, np.int64)
        low = high = np.searchsorted(self.at, centre)
        while reach < 2.0:
            lo = np.minimum(low, np.searchsorted(self.at, centre - reach))
            hi = np.maximum(high, np.searchsorted(self.at, centre + reach, side="right"))
            new = [self.order[a:b] for a, b in zip(np.r_[lo, high].tolist(), np.r_[low, hi].tolist()) if b > a]
            if new:
                count += np.bincount(np.concatenate(new), minlength=self.n)
            low, high = lo, hi
            found = np.flatnonzero(count >= threshold)
            if len(found) >= enough and (self.ids is None or len(np.unique(self.ids[found])) >= enough):
                return found
            reach *= growth
        return np.arange(self.n)


def search_block(base: pd.DataFrame, asked: pd.DataFrame, k: int, lines: int, windows: int, threshold: float, enough: int, seed: int) -> pd.DataFrame:
    """query_id, vec_id, score, verified: the best k of one block for each query, ties to the smaller vec_id, and how many were verified."""
    empty = pd.DataFrame({"query_id": [], "vec_id": [], "score": [], "verified": []}).astype({"query_id": "int64", "vec_id": "int64", "score": "float64", "verified": "int64"})
    if not len(base) or not len(asked):
        return empty
    x, ids = np.stack(base["embedding"].to_list()).astype(np.float64), base["vec_id"].to_numpy(np.int64)
    q, q_ids = np.stack(asked["embedding"].to_list()).astype(np.float64), asked["vec_id"].to_numpy(np.int64)
    unit = x / (float(np.sqrt(base["norm2"].iloc[0])) * (1 + 1e-12))
    unit = np.hstack([unit, np.sqrt(np.maximum(0, 1 - (unit**2).sum(1)))[:, None]])
    centre = np.hstack([q / np.linalg.norm(q, axis=1)[:, None], np.zeros((len(q), 1))])
    index, enough = None, min(enough, max(4 * k, -(-len(x) // SHARE)))
    if len(x) > enough:
        dirs = np.random.default_rng(seed).standard_normal((lines, unit.shape[1]))
        index = BlockIndex(unit, dirs / np.linalg.norm(dirs, axis=1)[:, None], ids)
    repeated = len(np.unique(ids)) < len(ids)
    out = []
    for i in range(len(q)):
        near = np.arange(len(x)) if index is None else index.candidates(centre[i], min(windows, lines), int(np.ceil(threshold * min(windows, lines))), enough)
        near = near[ids[near] != q_ids[i]]
        verified, score = len(near), x[near] @ q[i]
        if len(near) > 4 * k and not repeated:
            keep = score >= np.partition(score, -k)[-k]
            near, score = near[keep], score[keep]
        best = np.lexsort((ids[near], -score))
        if repeated:  # of an id, its best vector
            best = best[np.sort(np.unique(ids[near[best]], return_index=True)[1])]
        best = best[:k]
        out.append(pd.DataFrame({"query_id": q_ids[i], "vec_id": ids[near[best]], "score": score[best], "verified": verified}))
    return pd.concat(out, ignore_index=True)


def found_in_blocks(vectors: DataFrame, is_query: Column, k: int = 20, lines: int = 512, windows: int = 48, threshold: float = 0.41, enough: int = 500, block: int = 16384, query_block: int = 2048, seed: int = 11) -> DataFrame:
    """query_id, vec_id, score, verified: for each query row, the best k of each block of vectors; see nearest_neighbours()."""
    rows = usable(vectors.select("vec_id", "embedding")).distinct()
    norm2 = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    rows = checkpointed(rows.select("vec_id", "embedding", F.size("embedding").alias("length"), norm2.alias("norm2"), F.coalesce(is_query, F.lit(False)).alias("asks")))
    at_least_one = lambda n, size: F.greatest(F.lit(1), F.ceil(n / size)).cast("int")
    # One row for each length of vector.
    shapes = rows.groupBy("length").agg(F.max("norm2").alias("norm2"), at_least_one(F.count("*"), block).alias("blocks"), at_least_one(F.count_if("asks"), query_block).alias("asked"))
    placed = rows.drop("norm2").join(shapes, "length")
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    spread = F.xxhash64(F.lit(seed), "vec_id", "embedding")
    base = placed.select("vec_id", "embedding", "length", "norm2", F.pmod(spread, F.col("blocks")).cast("int").alias("b"), numbers("asked").alias("g"))
    queries = placed.where("asks").select(F.pmod(spread, F.col("asked")).cast("int").alias("g"), numbers("blocks").alias("b"), *[F.col(c).alias(f"q_{c}") for c in ("vec_id", "embedding", "length")])

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return search_block(left, right.rename(columns={"q_vec_id": "vec_id", "q_embedding": "embedding"}), k, lines, windows, threshold, enough, seed)

    return base.groupBy("length", "b", "g").cogroup(queries.groupBy("q_length", "b", "g")).applyInPandas(meet, "query_id long, vec_id long, score double, verified long")


def nearest_neighbours(vectors: DataFrame, is_query: Column, k: int = 20, **options) -> DataFrame:
    """query_id, rank, vec_id, score: each query row's k nearest of all other rows by inner product, nearest first.

    Columns vec_id and embedding; others are not looked at. Rows that usable() leaves out take no part, neither as
    queries nor as candidates. A query meets the vectors of its own length only. A query's own vec_id is no candidate.
    Fewer than k candidates: all of them. Ties go to the smaller vec_id. A vec_id that repeats is searched and found once
    for each different vector, and listed with the best score. An empty table gives no rows. `threshold` is the part of a
    query's `windows` that a vector must come into; `enough` vectors of each block, or a third of a small one, do so at
    least before any is verified. Only a block of no more than 4 * k vectors is verified whole.
    """
    found = found_in_blocks(vectors, is_query, k, **options)
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
