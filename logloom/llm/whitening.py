"""Whitening of embeddings by a randomised range finder.

The covariance of quantised vectors is never needed whole: a pass over all centred rows gives its product with a thin block
of directions, summed from a matrix for each partition. Random directions, some more than wanted, are passed through it and
made orthonormal again and again, so that they turn to the leading components; Rayleigh-Ritz on the last pass gives the
components within them, and the residual of each, set against the gap to the next eigenvalue, tells how far off it may
be. Where residuals fail after PASSES passes, as they do where eigenvalues lie close, the block is expanded to the
full dimension, of which one more pass gives components to double precision.

The driver holds matrices of dimension by directions; rows stay in the tasks. Sums that are to be exact are of whole numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.llm.common import stored

SCALE, SHIFT = 64, 1_000_000
#: Components wanted, random directions beyond them, and power passes before the block is expanded.
COMPONENTS, OVERSAMPLE, PASSES = 32, 10, 4
#: The largest error of a component (residual over gap) that counts as double precision.
PRECISE = 1e-10
#: An eigenvalue of less than so much of the largest, for each dimension, is rounding: no component.
ROUNDING = np.finfo(np.float64).eps
#: Entries beyond this have no exact quantised value in double precision.
LARGEST = 2.0**53
OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def quantised(vectors: DataFrame, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """vec_id, x: floor(64 * c) + 1000000 of each entry c. Vectors that are null, empty, or hold null, non-finite or
    unquantisable entries are left out."""
    c = F.col(column)
    whole = F.size(c) > 0
    fine = F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double") * SCALE) < LARGEST))
    x = F.transform(c, lambda v: F.floor(v.cast("double") * SCALE) + F.lit(SHIFT).cast("long"))
    return vectors.where(c.isNotNull() & whole & fine).select(F.col(id_column).cast("long").alias("vec_id"), x.alias("x"))


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """An Arrow list column of equal lengths as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def summed(rows: DataFrame, width: int, of) -> np.ndarray:
    """The sum over all rows of the matrices (some rows by width) that `of` gives for a batch, by partitions, then by matrix row."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                part = of(matrix(batch.column(0)))
                total = part if total is None else total + part
        if total is not None:
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(total) + 1) * width, pa.int32()), pa.array(total.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), flat], ["i", "v"])

    def added(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"i": [key[0]], "v": [np.sum(np.stack(pdf["v"].to_numpy()), axis=0)]})

    kind = "i int, v array<double>"
    parts = rows.select("x").mapInArrow(partial, kind).groupBy("i").applyInPandas(added, kind)
    return np.array([r["v"] for r in parts.orderBy("i").collect()])


def product(rows: DataFrame, mean: np.ndarray, n: int, block: np.ndarray) -> np.ndarray:
    """The covariance times block, by one pass over all centred rows."""

    def of(x: np.ndarray) -> np.ndarray:
        centred = x - mean
        return centred.T @ (centred @ block)

    return summed(rows, block.shape[1], of) / n


def ritz(block: np.ndarray, image: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Eigenvalues, falling, vectors and residuals of the covariance within an orthonormal block, image being its product."""
    small = block.T @ image
    values, turn = np.linalg.eigh((small + small.T) / 2)
    values, turn = values[::-1], turn[:, ::-1]
    return values, block @ turn, np.linalg.norm(image @ turn - block @ turn * values, axis=0)


def precise(values: np.ndarray, residuals: np.ndarray, wanted: int) -> bool:
    """Whether the wanted leading components are right: each one's residual is small beside the gap to its neighbours."""
    gaps = np.abs(np.diff(values))[:wanted]
    near = np.minimum(gaps, np.concatenate([[np.inf], gaps[:-1]]))
    return len(values) > wanted and bool(np.all(residuals[:wanted] <= PRECISE * near))


def components(rows: DataFrame, mean: np.ndarray, n: int, wanted: int = COMPONENTS, seed: int = 0) -> tuple[np.ndarray, np.ndarray, bool]:
    """The covariance's leading eigenvalues and unit eigenvectors (as columns), and whether the block had to be expanded.

    Eigenvalues that are rounding are left out, so that there may be fewer than wanted. Signs: the largest entry is positive.
    """
    dims, full = len(mean), False
    width = min(dims, wanted + OVERSAMPLE)
    block = np.linalg.qr(np.random.default_rng(seed).standard_normal((dims, width)))[0] if width < dims else np.eye(dims)
    for k in range(PASSES + 1):
        full = block.shape[1] == dims
        image = product(rows, mean, n, block)
        values, vectors, residuals = ritz(block, image)
        if full or precise(values, residuals, wanted):
            break
        block = np.linalg.qr(image)[0] if k < PASSES else block
    else:
        full, block = True, np.eye(dims)
        values, vectors, _ = ritz(block, product(rows, mean, n, block))
    kept = values[:wanted] > ROUNDING * dims * max(values[0], 0)
    values, vectors = values[:wanted][kept], vectors[:, :wanted][:, kept]
    signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])])
    return values, vectors * signs, full


def whiten(vectors: DataFrame, id_column: str = "vec_id", column: str = "embedding", wanted: int = COMPONENTS) -> DataFrame:
    """Rows (vec_id, component, n, deviation, whitened, explained, identity_error), for each vector and leading component.

    Quantised vectors x are whitened by the covariance of all of them: centred, projected and divided by the square root of
    the eigenvalue. deviation is the exact sum of (n * x - sum) ** 2, null where it is beyond a long. Vectors that are null,
    empty or hold null, non-finite or unquantisable entries are left out, and so are those whose length is not the most common one
    (of equally common lengths, the longer). Null and repeated ids stay as they are; repeated rows count as often as they are there.
    Vectors that do not vary have no components, and so give no rows; neither does an empty table. Other columns are left out.
    """
    spark = vectors.sparkSession
    rows = stored(quantised(vectors, id_column, column))
    lengths = rows.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), F.col("d").desc()).first()
    if lengths is None:
        return spark.createDataFrame([], OUT)
    dims, n = lengths["d"], lengths["n"]
    rows = rows.where(F.size("x") == dims)
    sums = rows.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("s")).orderBy("i").collect()
    exact = [int(r["s"]) for r in sums]
    mean = np.array([s / n for s in exact])
    values, axes, _ = components(rows, mean, n, wanted)
    if not len(values):
        return spark.createDataFrame([], OUT)
    scaled = axes / np.sqrt(values)
    trace = float(summed(rows, 1, lambda x: ((x - mean) ** 2).sum(axis=0)[:, None]).sum() / n)

    def white(x: np.ndarray) -> np.ndarray:
        return (x - mean) @ scaled

    centre = summed(rows, len(values), lambda x: white(x).sum(axis=0)[None, :])[0] / n

    def spread(x: np.ndarray) -> np.ndarray:
        w = white(x) - centre
        return w.T @ w

    error = float(np.abs(summed(rows, len(values), spread) / n - np.eye(len(values))).max())
    explained = values / trace
    safe = max(abs(s) for s in exact)

    def deviations(x: np.ndarray) -> list:
        largest = n * int(np.abs(x).max()) + safe
        if largest < 2**62 and dims * max(int(np.abs(x * n - np.array(exact)).max()), 1) ** 2 < 2**63:
            return ((x * n - np.array(exact)) ** 2).sum(axis=1).tolist()
        each = (sum((n * int(v) - s) ** 2 for v, s in zip(row, exact, strict=True)) for row in x)
        return [d if d < 2**63 else None for d in each]

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(values)
        for batch in batches:
            if not batch.num_rows:
                continue
            x, m = matrix(batch.column(1)), batch.num_rows
            ids = batch.column(0).take(pa.array(np.repeat(np.arange(m), k)))
            away = pa.array(deviations(x), pa.int64()).take(pa.array(np.repeat(np.arange(m), k)))
            columns = [ids, pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()), pa.array(np.full(m * k, n), pa.int64()), away, pa.array(white(x).ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error))]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(out, OUT)
