"""Matrix products, transposes and Gram matrices that no single task holds."""

import numpy as np
import pytest

from helpers import M1, RUN_ERRORS, grid_of, long_to_array, rows_of, wide_of
from stripgrid.block_matrix import BlockMatrix
from stripgrid.layout import Packed
from stripgrid.operators.block_products import gram_blocks, gram_cells
from stripgrid.sources.grids import from_blocks


def random(rows, cols, seed=1):
    return np.random.default_rng(seed).normal(size=(rows, cols))


A, B = random(37, 23), random(23, 19, seed=2)


@pytest.mark.parametrize("tile", [8, 16, 2048])
@pytest.mark.parametrize("groups", [1, 3, None])
def test_blocks_times_blocks_with_ragged_edges(spark, tile, groups):
    product = grid_of(spark, A, 10, 5).multiply(grid_of(spark, B, 5, 7), tile, groups)
    assert product.dim == (37, 19)
    assert np.allclose(product.to_local(), A @ B, atol=1e-12)
    # The result is an ordinary block matrix: it can be sliced, reduced and multiplied again.
    assert np.allclose(product[3:30, 2:11].to_local(), (A @ B)[3:30, 2:11], atol=1e-12)
    again = product @ grid_of(spark, random(19, 4, 3), 7, 2)
    assert np.allclose(again.to_local(), A @ B @ random(19, 4, 3), atol=1e-12)


@pytest.mark.parametrize("tile,groups", [(8, 2), (2048, 1), (2048, None)])
def test_rows_times_blocks_and_rows_times_rows(spark, tile, groups):
    for left in (rows_of(spark, A), wide_of(spark, A)):
        product = left.multiply(grid_of(spark, B, 5, 7), tile, groups)
        assert product.n_cols == 19 and np.allclose(product.to_local(), A @ B, atol=1e-12)
    product = rows_of(spark, A).multiply(rows_of(spark, B), tile, groups)
    assert np.allclose(product.to_local(), A @ B, atol=1e-12)


def test_inner_dimension_wider_than_a_cut(spark):
    a, b = random(5, 1100), random(1100, 700, 2)
    assert np.allclose((rows_of(spark, a) @ rows_of(spark, b)).to_local(), a @ b, atol=1e-10)


def test_irregular_blocks(spark):
    def blocks(array, heights, widths):
        tops, lefts = np.cumsum([0, *heights]), np.cumsum([0, *widths])
        data = [
            (i, j, h, w, array[tops[i] : tops[i] + h, lefts[j] : lefts[j] + w].ravel().tolist())
            for i, h in enumerate(heights)
            for j, w in enumerate(widths)
        ]
        schema = "block_row int, block_col int, n_rows int, n_cols int, vals array<double>"
        return from_blocks(spark.createDataFrame(data, schema))

    left, right = blocks(A, [20, 1, 16], [3, 13, 7]), blocks(B, [3, 13, 7], [19])
    assert np.allclose((left @ right).to_local(), A @ B, atol=1e-12)
    assert np.allclose((rows_of(spark, A) @ right).to_local(), A @ B, atol=1e-12)


def test_blocks_that_are_not_stored_count_as_zero(spark):
    holes = BlockMatrix(grid_of(spark, B, 5, 7).df.where("(block_row + block_col) % 2 = 0"), (23, 19))
    dense = np.zeros(B.shape)
    for i in range(5):
        for j in range(3):
            if (i + j) % 2 == 0:
                dense[i * 5 : i * 5 + 5, j * 7 : j * 7 + 7] = B[i * 5 : i * 5 + 5, j * 7 : j * 7 + 7]
    left = grid_of(spark, A, 10, 5)
    assert np.allclose((left @ holes).to_local(), A @ dense, atol=1e-12)
    only = BlockMatrix(holes.df.where("block_col = 2"), (23, 19))
    dense[:, :14] = 0
    assert np.allclose((rows_of(spark, A) @ only).to_local(), A @ dense, atol=1e-12)


def test_sizes_and_cuts_must_fit(spark):
    left = grid_of(spark, A, 10, 5)
    with pytest.raises(ValueError, match="cannot multiply 37 x 23 by 37 x 23"):
        left @ left
    with pytest.raises(ValueError, match="same inner positions"):
        left @ grid_of(spark, B, 6, 7)
    unknown = BlockMatrix(grid_of(spark, B, 6, 7).df)
    with pytest.raises(RUN_ERRORS, match="inner blocks differ"):
        (left @ unknown).to_local()
    with pytest.raises(ValueError, match="cannot multiply"):
        rows_of(spark, A) @ rows_of(spark, A)
    with pytest.raises(TypeError):
        left @ rows_of(spark, B)


def test_each_side_is_shuffled_once_and_never_crossed(spark):
    product = grid_of(spark, A, 10, 5).multiply(grid_of(spark, B, 5, 7), groups=1)
    plan = product.df._jdf.queryExecution().executedPlan().toString()
    # Two exchanges build the grids, one deals both sides to tiles.
    assert plan.count("Exchange hashpartitioning") == 3 and "Cartesian" not in plan and "NestedLoop" not in plan


def test_transpose_of_blocks(spark):
    grid = grid_of(spark, A, 10, 5)
    turned = grid.T
    assert turned.dim == (23, 37) and np.array_equal(turned.to_local(), A.T)
    assert np.array_equal(turned.T.to_local(), A)
    assert np.array_equal(turned[4:20, 8:31].to_local(), A.T[4:20, 8:31])
    plan = grid_of(spark, A, 10, 5).T.df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1  # the one that builds the grid
    gram = (turned @ grid).to_local()
    assert np.allclose(gram, A.T @ A, atol=1e-12)


def test_transpose_of_rows(spark):
    for matrix in (rows_of(spark, A), wide_of(spark, A)):
        turned = matrix.transpose(4, 9)
        assert np.array_equal(turned.to_local(), A.T)
        assert max(r.n_cols for r in turned.directory().collect()) <= 9
        assert np.array_equal(turned.to_rows().transpose(50, 50).to_local(), A)
    assert np.array_equal(rows_of(spark, M1).transpose().to_local(), M1.T)


@pytest.mark.parametrize("tile,groups", [(7, 1), (7, 4), (64, None)])
def test_gram_by_tiles(spark, tile, groups):
    for matrix in (rows_of(spark, A), wide_of(spark, A)):
        blocks = gram_blocks(matrix.base, [matrix.cells], tile, groups)
        assert np.allclose(long_to_array(gram_cells(blocks), (23, 23)), A.T @ A, atol=1e-12)


def test_gram_of_5000_columns(spark):
    wide = random(40, 5000)
    matrix = rows_of(spark, wide)
    gram = matrix.gram()
    assert gram.columns == ["i", "j", "value"]
    some = gram.where("i % 499 = 0 and j % 7 = 3").collect()
    want = wide.T @ wide
    assert len(some) == 11 * 714 and all(abs(r.value - want[r.i, r.j]) < 1e-9 for r in some)
    assert gram.count() == 5000**2


def test_gram_of_an_empty_matrix(spark):
    empty = rows_of(spark, A).replace(rows_of(spark, A).base.where("false"), Packed("vec", 23))
    assert gram_cells(gram_blocks(empty.base, [empty.cells], 7)).count() == 0


def test_a_large_local_matrix_is_dealt_out(spark, monkeypatch):
    from stripgrid.operators import products

    monkeypatch.setattr(products, "LOCAL_CELLS", 100)
    assert np.allclose(rows_of(spark, A).times_local(B).to_local(), A @ B, atol=1e-12)
    with pytest.raises(ValueError, match="too large to travel"):
        products.times_local(rows_of(spark, A).base, rows_of(spark, A).cells, B, ["row_id"], "vec")


def test_a_resizing_strip_function_runs_once_per_strip(spark):
    calls = spark.sparkContext.accumulator(0)

    def means(rows):
        calls.add(1)
        return rows.mean(axis=0)

    found = rows_of(spark, A).map_strips(means, 10, keep_rows=False).to_local()
    assert np.allclose(found, [A[i : i + 10].mean(axis=0) for i in (0, 10, 20, 30)]) and calls.value == 4
