"""Whitening against a plain eigendecomposition."""

import numpy as np
import pytest

from logloom.llm import queries, whitening

COLUMNS = "vec_id long, embedding array<float>"


def plain(vectors, wanted=32):
    """Quantised vectors, eigenvalues and whitened vectors (up to sign) of a list of vectors."""
    x = np.floor(np.array(vectors, np.float32).astype(np.float64) * 64) + 1_000_000
    away = x - x.mean(axis=0)
    values, axes = np.linalg.eigh(away.T @ away / len(x))
    values, axes = values[::-1], axes[:, ::-1]
    kept = [k for k in range(min(wanted, len(values))) if values[k] > values[0] * 1e-13]
    return x, values, away @ axes[:, kept] / np.sqrt(values[kept])


def agree(rows, ids, vectors):
    x, values, white = plain(vectors)
    n, k = len(x), white.shape[1]
    assert len(rows) == n * k
    got = {(r.vec_id, r.component): r for r in rows}
    w = np.array([[got[i, c].whitened for c in range(1, k + 1)] for i in ids])
    assert np.abs(w * np.sign((w * white).sum(axis=0)) - white).max() < 1e-7
    sums = [int(s) for s in x.sum(axis=0)]
    for i, row in zip(ids, x, strict=True):
        r = got[i, 1]
        assert (r.n, r.deviation) == (n, sum((n * int(v) - s) ** 2 for v, s in zip(row, sums, strict=True)))
    assert [got[ids[0], c].explained for c in range(1, k + 1)] == pytest.approx(list(values[:k] / values.sum()), rel=1e-9)
    assert {r.identity_error for r in rows}.pop() < 1e-9


def test_query_on_the_whole_table(spark, sf_dir):
    data = spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()
    agree(queries.op11_embedding_whitening(spark, sf_dir).collect(), [r.vec_id for r in data], [r.embedding for r in data])


@pytest.mark.parametrize("steep", [True, False])
def test_expands_only_if_residuals_fail(spark, steep):
    r = np.random.default_rng(4)
    scales = np.concatenate([1.1 ** -np.arange(32.0), np.full(48, 1e-5 if steep else 1.1**-31)]) * 1e6
    vectors = (r.normal(size=(3000, 80)) * scales).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], COLUMNS).repartition(7)
    rows = whitening.quantised(df).cache()
    x, values, white = plain(vectors)
    mean = x.mean(axis=0)
    got, axes, expanded = whitening.components(rows, mean, len(x))
    assert expanded != steep and got == pytest.approx(list(values[:32]), rel=1e-9)
    w = (x - mean) @ axes / np.sqrt(got)
    assert np.abs(w * np.sign((w * white).sum(axis=0)) - white).max() < 1e-6
    assert np.abs(axes.T @ axes - np.eye(32)).max() < 1e-12


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    good = [[1.0, 2.0, -1.0], [0.5, -3.0, 2.0], [2.5, 0.25, 0.0], [2.5, 0.25, 0.0], [-4.0, 1.0, 1.0]]
    bad = [None, [], [None, 1.0, 1.0], [nan, 1.0, 1.0], [inf, 1.0, 1.0], [1e30, 1.0, 1.0], [1.0, 2.0], [1.0, 2.0, 3.0, 4.0]]
    df = spark.createDataFrame([(i, v, "a", "b") for i, v in enumerate(good + bad)], COLUMNS + ", x string, n string")
    agree(whitening.whiten(df).collect(), list(range(5)), good)
    ids = spark.createDataFrame([(None, v) for v in good[:2]] + [(7, v) for v in good[:2]], COLUMNS)
    rows = whitening.whiten(ids).collect()
    assert len(rows) == 4 and [r.vec_id for r in rows].count(None) == 2 and {r.n for r in rows} == {4}, "two different vectors vary in one direction"
    for none in (df.where("false"), df.where("vec_id >= 5 and vec_id < 11"), df.where("vec_id in (2, 3)")):
        assert whitening.whiten(none).count() == 0


def test_deviation_beyond_a_long_is_null(spark):
    df = spark.createDataFrame([(1, [1e12, 0.0]), (2, [-1e12, 1.0]), (3, [0.0, 3.0])], COLUMNS)
    assert {r.vec_id: r.deviation for r in whitening.whiten(df).collect()}[1] is None
