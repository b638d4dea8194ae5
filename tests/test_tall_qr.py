import numpy as np
import pytest
from helpers import long_to_array, positive, rows_of, wide_of
from pyspark.sql import functions as F

from stripgrid.plans import tall_qr
from stripgrid.plans.tall_qr import condition_numbers, local_r, singular_values, thin_qr
from stripgrid.sources.random import random_normal, random_uniform

ROUTES = ["projected", "direct"]


def check(matrix, array, route="auto", tolerance=1e-8):
    factor = thin_qr(matrix, route)
    q, r = factor.q.to_local(), factor.r
    assert np.abs(q.T @ q - np.eye(q.shape[1])).max() < tolerance
    assert np.abs(q @ r - array).max() < tolerance
    return q, r


def test_r_of_128_by_16(spark):
    matrix = random_uniform(spark, 128, 16, seed=1, partitions=4)
    expected = positive(np.linalg.qr(matrix.to_local())[1])
    assert np.abs(long_to_array(matrix.qr_r(), (16, 16)) - expected).max() < 1e-8


@pytest.mark.parametrize("route", ROUTES)
def test_q_and_r_of_128_by_4(spark, route):
    matrix = random_uniform(spark, 128, 4, seed=2, partitions=4)
    array = matrix.to_local()
    q, r = check(matrix, array, route)
    assert np.abs(r - positive(np.linalg.qr(array)[1])).max() < 1e-8


@pytest.mark.parametrize("route", ROUTES)
def test_empty_partitions(spark, route):
    array = random_normal(spark, 16, 4, seed=3).to_local()
    matrix = rows_of(spark, array, 2)
    spread = matrix.replace(matrix.base.repartition(16, F.col("row_id") % 2), matrix.cells)
    check(spread, array, route)


@pytest.mark.parametrize("route", ROUTES)
def test_irregular_strips(spark, route):
    matrix = random_uniform(spark, 10, 4, seed=4, partitions=2)
    check(matrix[4:10, :], matrix.to_local()[4:10], route)


@pytest.mark.parametrize("partitions", [1, 3, 17])
def test_r_does_not_depend_on_partitioning(spark, partitions):
    array = np.random.default_rng(7).normal(size=(203, 5))
    assert np.allclose(local_r(rows_of(spark, array, partitions)), positive(np.linalg.qr(array)[1]), atol=1e-12)
    assert np.allclose(local_r(wide_of(spark, array, partitions)), positive(np.linalg.qr(array)[1]), atol=1e-12)


def test_more_columns_than_rows(spark):
    array = np.random.default_rng(8).normal(size=(3, 5))
    matrix = rows_of(spark, array, 2)
    assert np.allclose(local_r(matrix), positive(np.linalg.qr(array)[1]))
    q, r = check(matrix, array)
    assert q.shape == (3, 3) and r.shape == (3, 5)


def test_rank_deficient_matrix_still_has_an_orthonormal_q(spark):
    array = np.random.default_rng(9).normal(size=(50, 4))
    array[:, 3] = array[:, 0]
    check(rows_of(spark, array, 5), array, tolerance=1e-12)


@pytest.mark.parametrize("condition", [1e6, 1e10, 1e15])
def test_q_stays_orthogonal_when_ill_conditioned(spark, condition):
    rng = np.random.default_rng(10)
    u = np.linalg.qr(rng.normal(size=(400, 8)))[0]
    v = np.linalg.qr(rng.normal(size=(8, 8)))[0]
    array = u @ np.diag(condition ** (-np.arange(8) / 7)) @ v
    check(rows_of(spark, array, 6), array, tolerance=1e-12)


def test_direct_route_with_many_blocks_and_levels(spark, monkeypatch):
    monkeypatch.setattr(tall_qr, "BLOCK_BYTES", 1)
    monkeypatch.setattr(tall_qr, "FAN_IN", 2)
    array = np.random.default_rng(11).normal(size=(300, 3))
    q, r = check(rows_of(spark, array, 4), array, "direct", 1e-12)
    assert np.abs(r - positive(np.linalg.qr(array)[1])).max() < 1e-12


def test_condition_numbers(spark):
    array = np.random.default_rng(12).normal(size=(80, 6))
    matrix = rows_of(spark, array)
    r = np.linalg.qr(array)[1]
    row = condition_numbers(matrix).head()
    assert row.cond_2 == pytest.approx(np.linalg.cond(array))
    assert row.cond_1 == pytest.approx(np.linalg.cond(r, 1))
    assert matrix.cond_est() == pytest.approx(row.cond_1)
    assert matrix.cond_est(np.eye(3)) == 1.0
    sigma = [s.sigma for s in singular_values(matrix).orderBy("i").collect()]
    assert np.allclose(sigma, np.linalg.svd(array, compute_uv=False))
    array[:, 5] = 0.0
    assert condition_numbers(rows_of(spark, array)).head().cond_1 == np.inf


def test_width_limit_is_stated(spark):
    wide = random_uniform(spark, 4, 5000)
    with pytest.raises(ValueError, match="block QR"):
        wide.qr_r()


def test_unknown_route(spark):
    with pytest.raises(ValueError):
        thin_qr(random_uniform(spark, 4, 2), "fast")
