"""Randomised SVD by passes over a sparse table, against numpy's on the whole matrix."""

import numpy as np
import pytest
from pyspark.ml.linalg import SparseVector, VectorUDT
from pyspark.sql import types as T

from sardonyx.operators import svd as S

SCHEMA = T.StructType([T.StructField("features", VectorUDT())])


def table(spark, a, parts):
    rows = [(SparseVector(a.shape[1], {int(j): float(x[j]) for j in np.flatnonzero(x)}),) for x in a]
    return spark.createDataFrame(rows, SCHEMA).repartition(parts)


def sparse_matrix(seed, n=300, d=60, rank=6, noise=0.05):
    rng = np.random.default_rng(seed)
    a = rng.standard_normal((n, rank)) @ (rng.standard_normal((rank, d)) * np.geomspace(8, 1, rank)[:, None])
    a += noise * rng.standard_normal((n, d))
    return np.where(rng.random((n, d)) < 0.5, a, 0.0)


@pytest.mark.parametrize("parts", [1, 5])
def test_reconstruction_error_against_numpy(spark, parts):
    a = sparse_matrix(3)
    rows = S.sparse_rows(table(spark, a, parts))
    got = S.truncated_svd(rows, a.shape[1], 8)
    _, values, vt = np.linalg.svd(a, full_matrices=False)
    v = got.components
    assert np.allclose(v.T @ v, np.eye(8), atol=1e-9) and np.all(np.diff(got.values) <= 1e-9)
    best = np.linalg.norm(a - a @ vt[:8].T @ vt[:8])
    assert np.linalg.norm(a - a @ v @ v.T) <= 1.01 * best
    assert np.allclose(got.values[:6], values[:6], rtol=0.01) and got.rows == len(a)


def test_gram_product_is_exact(spark):
    a = sparse_matrix(5, n=1500, d=40)
    a[7] = 0
    g = np.random.default_rng(1).standard_normal((40, 5))
    assert np.allclose(S.gram_product(S.sparse_rows(table(spark, a, 4)), g), a.T @ (a @ g))


def test_projection_saves_and_scales(spark, tmp_path):
    from pyspark.ml.feature import PCAModel
    a = sparse_matrix(9, n=200, d=30)
    df = table(spark, a, 3)
    svd = S.truncated_svd(S.sparse_rows(df), 30, 5)
    model = S.projection(spark, svd, "features", "dense")
    z = np.array([r["dense"].toArray() for r in model.transform(df).collect()])
    assert z.shape == (200, 5) and np.allclose((z ** 2).mean(axis=0), 1.0, rtol=0.05)
    model.write().overwrite().save(str(tmp_path / "m"))
    again = np.array([r["dense"].toArray() for r in PCAModel.load(str(tmp_path / "m")).transform(df).collect()])
    assert np.array_equal(z, again)
    plain = S.projection(spark, svd, "features", "dense", even=False)
    x = df.collect()[0]["features"].toArray()
    assert np.allclose(plain.transform(df).collect()[0]["dense"].toArray(), x @ svd.components)


def test_few_rows_and_empty_tables(spark):
    a = np.zeros((2, 20))
    a[0, 3] = 2.0
    svd = S.truncated_svd(S.sparse_rows(table(spark, a, 2)), 20, 4)
    assert np.allclose(svd.values, [2, 0, 0, 0], atol=1e-6) and svd.rows == 1
    z = S.projection(spark, svd, "features", "dense").transform(table(spark, a, 1)).collect()
    assert all(np.isfinite(r["dense"].toArray()).all() for r in z)
    none = S.truncated_svd(S.sparse_rows(table(spark, a, 1).limit(0)), 20, 4)
    assert np.all(none.values == 0) and none.rows == 0
