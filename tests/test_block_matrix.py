import numpy as np
import pytest
from helpers import M1, M3, RUN_ERRORS, grid_of, positive, rows_of
from pyspark.sql import functions as F

from stripgrid.block_matrix import BlockMatrix
from stripgrid.operators.folding import tree_levels
from stripgrid.sources import storage
from stripgrid.sources.grids import from_blocks, to_grid

ARRAY = np.random.default_rng(8).normal(size=(23, 11))
OPS = [("sum", np.add), ("prod", np.multiply), ("min", np.minimum), ("max", np.maximum), (np.hypot, np.hypot)]


@pytest.mark.parametrize("shape", [(1, 1), (2, 1), (2, 3)])
def test_row_product_and_sums(spark, shape):
    grid = grid_of(spark, M1, *shape)
    product = grid.reduce_row_elements("prod")
    assert product.to_local().tolist() == [[6.0], [-9.0], [0.0], [0.0]]
    assert product.dim == (4, 1)
    sums = {row.row_id: row.value for row in grid.row_sums().collect()}
    assert sums == {0: 6.0, 1: 9.0, 2: 1.0, 3: 1.0}


def test_column_product_and_sums(spark):
    grid = grid_of(spark, M3, 1, 3)
    product = grid.reduce_col_elements("prod")
    assert product.to_local().tolist() == [[7.0, 0.0, -1618.0]]
    assert product.dim == (1, 3)
    assert [row.value for row in grid.col_sums().orderBy("j").collect()] == [10.0, 12.0, 1619.0]


def test_ragged_grid_round_trip(spark):
    grid = grid_of(spark, ARRAY, 5, 4)
    assert grid.dim == (23, 11) and grid.length() == 253
    assert np.array_equal(grid.to_local(), ARRAY)
    corner = grid.directory().filter("block_row = 4 and block_col = 2").head()
    assert (corner.row_start, corner.col_start, corner.n_rows, corner.n_cols) == (20, 8, 3, 3)
    assert grid.column_panels() == [(0, 0, 4), (1, 4, 4), (2, 8, 3)]


@pytest.mark.parametrize("op, ufunc", OPS)
def test_reductions_of_a_ragged_grid(spark, op, ufunc):
    grid = grid_of(spark, ARRAY, 5, 4)
    assert np.allclose(grid.reduce_row_elements(op).to_local()[:, 0], ufunc.reduce(ARRAY, axis=1))
    assert np.allclose(grid.reduce_col_elements(op).to_local()[0], ufunc.reduce(ARRAY, axis=0))
    assert grid.reduce_elements(op) == pytest.approx(ufunc.reduce(ARRAY.ravel()))


def test_element_wise_and_norm(spark):
    grid = grid_of(spark, ARRAY, 5, 4)
    assert np.allclose((((grid + 2) * 3 - 1) / 4).to_local(), ((ARRAY + 2) * 3 - 1) / 4)
    assert np.allclose(grid.pow(2).to_local(), ARRAY**2)
    assert np.array_equal(grid.map_elements(F.abs).to_local(), np.abs(ARRAY))
    assert grid.norm_frobenius() == pytest.approx(np.linalg.norm(ARRAY))
    total = grid.aggregate_elements(
        (0.0,), lambda s, x: (s[0] + float(x.sum()),), lambda s, t: (s[0] + t[0],), "total double"
    )
    assert total[0] == pytest.approx(ARRAY.sum())


def test_addition(spark):
    grid = grid_of(spark, ARRAY, 5, 4)
    assert np.allclose((grid + grid * 2).to_local(), 3 * ARRAY)
    assert np.array_equal((grid - grid).to_local(), 0 * ARRAY)
    for other in (grid_of(spark, ARRAY, 5, 3), grid_of(spark, ARRAY[:20], 5, 4)):
        with pytest.raises(RUN_ERRORS, match="unequal blocks"):
            (grid + other).to_local()
    with pytest.raises(TypeError):
        grid + rows_of(spark, ARRAY)


@pytest.mark.parametrize(
    "rows, cols",
    [
        (slice(3, 17), slice(None)),
        (slice(None), slice(3, 9)),
        (slice(6, 9), slice(5, 6)),
        (slice(10, 99), slice(0, 99)),
        (slice(0, 0), slice(None)),
        (slice(99, 120), slice(None)),
    ],
)
def test_slices_renumber_blocks(spark, rows, cols):
    part = grid_of(spark, ARRAY, 5, 4)[rows, cols]
    expected = ARRAY[rows, cols]
    if expected.size:
        assert np.array_equal(part.to_local(), expected)
        first = part.directory().agg(F.min("block_row"), F.min("block_col"), F.min("row_start"), F.min("col_start"))
        assert tuple(first.head()) == (0, 0, 0, 0)
    else:
        assert part.df.count() == 0 and part.dim == (0, 0)


def test_slice_of_a_slice(spark):
    once = grid_of(spark, ARRAY, 5, 4)[3:20, 2:10]
    assert np.array_equal(once[4:15, 1:7].to_local(), ARRAY[7:18, 3:9])


def test_block_range_and_column(spark):
    grid = grid_of(spark, ARRAY, 5, 4)
    part = grid.block_range(1, 4, 1, 3)
    assert np.array_equal(part.to_local(), ARRAY[5:20, 4:11])
    column = grid.col_block(2)
    assert column.dim == (23, 3) and np.array_equal(column.to_local(), ARRAY[:, 8:11])


def test_blocks_of_any_size(spark):
    blocks = spark.createDataFrame(
        [
            (4, 1, 1, 2, [1.0, 2.0]),
            (4, 5, 1, 1, [3.0]),
            (9, 1, 2, 2, [4.0, 5.0, 7.0, 8.0]),
            (9, 5, 2, 1, [6.0, 9.0]),
        ],
        "block_row int, block_col int, n_rows int, n_cols int, vals array<double>",
    )
    grid = from_blocks(blocks)
    assert grid.to_local().tolist() == [[1, 2, 3], [4, 5, 6], [7, 8, 9]]
    assert {tuple(row) for row in grid.directory().select("block_row", "block_col").collect()} == {
        (0, 0),
        (0, 1),
        (1, 0),
        (1, 1),
    }
    uneven = blocks.withColumn("n_rows", F.when(F.col("block_col") == 5, 7).otherwise(F.col("n_rows")))
    with pytest.raises(RUN_ERRORS, match="must have the same n_rows"):
        from_blocks(uneven).to_local()


def test_stored_blocks_prune(spark, tmp_path):
    grid = grid_of(spark, ARRAY, 5, 4)
    storage.write_blocks(grid, str(tmp_path / "grid"))
    stored = storage.read_blocks(spark, str(tmp_path / "grid"))
    assert np.array_equal(stored.to_local(), ARRAY)
    part = stored.df.filter("block_col = 1 and block_row >= 2")
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert "block_col#" in plan.split("PartitionFilters")[1].split("]")[0]
    assert "GreaterThanOrEqual(block_row,2)" in plan
    storage.write_rows(rows_of(spark, ARRAY), str(tmp_path / "rows"))
    assert np.array_equal(storage.read_rows(spark, str(tmp_path / "rows")).to_local(), ARRAY)


@pytest.mark.parametrize("shape, block", [((100, 30), (20, 10)), ((40, 40), (8, 20)), ((15, 25), (10, 10)), ((9, 7), (4, 3))])
def test_block_qr(spark, shape, block):
    array = np.random.default_rng(sum(shape)).normal(size=shape)
    r = grid_of(spark, array, *block).qr_r()
    expected = positive(np.linalg.qr(array)[1])
    assert r.dim == expected.shape
    assert np.abs(r.to_local() - expected).max() < 1e-8


def test_block_qr_with_a_dependent_panel_still_reproduces_the_gram(spark):
    array = np.random.default_rng(5).normal(size=(60, 6))
    array[:, 3] = array[:, 2]
    r = grid_of(spark, array, 20, 2).qr_r().to_local()
    assert np.allclose(r.T @ r, array.T @ array)


def test_grid_is_keyed_by_row_id_and_not_by_arrival(spark):
    shuffled = rows_of(spark, ARRAY).replace(
        rows_of(spark, ARRAY).base.orderBy(F.desc("row_id")).repartition(3), rows_of(spark, ARRAY).cells
    )
    assert np.array_equal(to_grid(shuffled, 6, 6).to_local(), ARRAY)


def test_merge_tree_has_bounded_fan_in():
    for partials, levels in ((0, 0), (1, 0), (32, 0), (33, 1), (1024, 1), (1025, 2), (3000, 2), (32769, 3)):
        assert tree_levels(partials, 32) == levels
        assert partials <= 32 ** (levels + 1)


def test_slices_without_known_boundaries_agree(spark):
    grid = grid_of(spark, ARRAY, 5, 4)
    loose = from_blocks(grid.df.select("block_row", "block_col", "n_rows", "n_cols", "vals"))
    assert grid.row_steps is not None and loose.row_steps is None
    for rows, cols in [(slice(3, 17), slice(3, 9)), (slice(10, 12), slice(None))]:
        known, found = grid[rows, cols], loose[rows, cols]
        order = ["block_row", "block_col"]
        assert known.directory().orderBy(*order).collect() == found.directory().orderBy(*order).collect()
    again, loosely = grid[3:20, 2:10][4:15, 1:7].block_range(1, 3, 0, 2), loose[3:20, 2:10][4:15, 1:7].block_range(1, 3, 0, 2)
    assert np.array_equal(again.to_local(), loosely.to_local())


@pytest.mark.parametrize("shape,block", [((100, 100), (20, 10)), ((64, 9), (7, 4)), ((37, 11), (40, 11)), ((30, 30), (1, 7))])
def test_block_qr_routes_agree(spark, shape, block):
    array = np.random.default_rng(5).normal(size=shape)
    want = np.linalg.qr(array)[1]
    want *= np.where(np.diagonal(want) < 0, -1.0, 1.0)[:, None]
    for route in ("strips", "blocks"):
        r = grid_of(spark, array, *block).qr_r(route)
        assert r.dim == want.shape and np.abs(r.to_local() - want).max() < 1e-8


def test_block_qr_on_strips_with_badly_scaled_and_close_columns(spark):
    """The second projection keeps later panels orthogonal to earlier ones: R'R = A'A to rounding of each column."""
    draw = np.random.default_rng(6)
    array = draw.normal(size=(80, 12)) * 10.0 ** draw.integers(-4, 5, 12)
    array[:, 8:] = array[:, :4] + 1e-6 * np.abs(array[:, :4]).max(axis=0) * draw.normal(size=(80, 4))
    r = grid_of(spark, array, 9, 4).qr_r("strips").to_local()
    want = np.linalg.qr(array)[1]
    want *= np.where(np.diagonal(want) < 0, -1.0, 1.0)[:, None]
    assert np.all(np.abs(r - want) <= 1e-9 * np.linalg.norm(array, axis=0))


def test_block_qr_on_strips_fills_blocks_that_are_not_stored(spark):
    array = np.random.default_rng(7).normal(size=(24, 8))
    array[8:16, 2:4] = 0
    grid = BlockMatrix(grid_of(spark, array, 8, 2).df.where("not (block_row = 1 and block_col = 1)"), (24, 8))
    r = grid.qr_r("strips").to_local()
    assert np.allclose(r.T @ r, array.T @ array)


def test_nearly_dependent_panels_turn_to_blocks(spark):
    array = np.random.default_rng(8).normal(size=(40, 6))
    array[:, 3] = array[:, 2]
    grid = grid_of(spark, array, 10, 2)
    with pytest.raises(ValueError, match="nearly dependent"):
        grid.qr_r("strips")
    r = grid.qr_r().to_local()
    assert np.allclose(r.T @ r, array.T @ array)
    with pytest.raises(ValueError, match="route"):
        grid.qr_r("fast")


def test_block_qr_on_strips_deals_the_matrix_once(spark, monkeypatch):
    """Only the first store has an exchange of blocks under it."""
    from stripgrid.plans import strip_qr

    plans, store = [], strip_qr.cut_lineage

    def watched(frame):
        plans.append(frame._jdf.queryExecution().executedPlan().toString())
        return store(frame)

    monkeypatch.setattr(strip_qr, "cut_lineage", watched)
    array = np.random.default_rng(9).normal(size=(60, 10))
    grid = grid_of(spark, array, 10, 2)
    grid = BlockMatrix(grid.df.cache(), (60, 10), grid.steps)
    grid.qr_r("strips").to_local()
    own = [plan.split("InMemoryRelation")[0].count("Exchange") for plan in plans]
    assert own == [1, 0, 0, 0, 0] and len(plans) == 5
    grid.df.unpersist()
