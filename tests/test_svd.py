import numpy as np
import pytest

from helpers import rows_of, wide_of
from stripgrid.layout import Packed
from stripgrid.plans.tall_qr import svd


def check(matrix, array, kept, **options):
    found = svd(matrix, **options)
    u, s, v = found.u.to_local(), found.sigma, found.v
    assert u.shape == (len(array), kept) and s.shape == (kept,) and v.shape == (array.shape[1], kept)
    assert np.abs(u.T @ u - np.eye(kept)).max(initial=0) < 1e-12 and np.abs(v.T @ v - np.eye(kept)).max(initial=0) < 1e-12
    want = np.linalg.svd(array, compute_uv=False)[:kept]
    assert np.allclose(s, want, atol=1e-10 * max(1, want.max(initial=0)))
    if not kept:
        return u, s, v
    leading = np.abs(v).argmax(axis=0)
    assert np.all(v[leading, np.arange(kept)] > 0)
    return u, s, v


@pytest.mark.parametrize("route", ["auto", "projected", "direct"])
def test_all_routes_rebuild_the_matrix(spark, route):
    array = np.random.default_rng(1).normal(size=(90, 7)) * 10.0 ** np.arange(7)
    for matrix in (rows_of(spark, array), wide_of(spark, array)):
        u, s, v = check(matrix, array, 7, route=route)
        assert np.allclose(u * s @ v.T, array, atol=1e-9 * np.abs(array).max())


def test_rank_deficient_input_gives_its_numerical_rank(spark):
    array = np.random.default_rng(2).normal(size=(60, 6))
    array[:, 4], array[:, 5] = array[:, 0] - 2 * array[:, 1], 0.0
    u, s, v = check(rows_of(spark, array), array, 4)
    assert np.allclose(u * s @ v.T, array, atol=1e-12)


def test_truncation_by_rank_and_tolerance(spark):
    array = np.random.default_rng(3).normal(size=(50, 5)) @ np.diag([100, 10, 1, 0.1, 0.01])
    u, s, v = check(rows_of(spark, array), array, 2, rank=2)
    best = np.linalg.svd(array, full_matrices=False)
    assert np.allclose(u * s @ v.T, (best[0][:, :2] * best[1][:2]) @ best[2][:2], atol=1e-9)
    check(rows_of(spark, array), array, 3, tolerance=0.005)
    check(rows_of(spark, array), array, 0, rank=0)
    with pytest.raises(ValueError):
        svd(rows_of(spark, array), rank=-1)


def test_fewer_rows_than_columns_zeros_and_no_rows(spark):
    array = np.random.default_rng(4).normal(size=(3, 5))
    u, s, v = check(rows_of(spark, array), array, 3)
    assert np.allclose(u * s @ v.T, array, atol=1e-12)
    check(rows_of(spark, np.zeros((8, 3))), np.zeros((8, 3)), 0)
    none = rows_of(spark, array).replace(rows_of(spark, array).base.where("false"), Packed("vec", 5), n_rows=None)
    found = svd(none)
    assert found.u.base.count() == 0 and found.sigma.shape == (0,) and found.v.shape == (5, 0)
    assert none.norm_2() == 0.0


def test_two_norm_and_long_v(spark):
    array = np.random.default_rng(5).normal(size=(40, 4))
    matrix = rows_of(spark, array)
    assert matrix.norm_2() == pytest.approx(np.linalg.norm(array, 2))
    found = matrix.svd()
    cells = {(r.i, r.j): r.value for r in found.v_long().collect()}
    assert cells == {(i, j): found.v[i, j] for i in range(4) for j in range(4)}
