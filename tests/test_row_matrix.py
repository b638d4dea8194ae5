import numpy as np
import pytest
from helpers import M1, M2, M4, RUN_ERRORS, rows_of, wide_of
from pyspark.sql import functions as F

from stripgrid.layout import Wide
from stripgrid.operators import reductions, shape
from stripgrid.plans.compare import about_equal, co_partition
from stripgrid.sources.random import random_normal, random_uniform
from stripgrid.sources.tables import from_arrays, from_columns, from_strips

LAYOUTS = [rows_of, wide_of]


@pytest.mark.parametrize("layout", LAYOUTS)
def test_row_product_and_sums(spark, layout):
    matrix = layout(spark, M1)
    product = matrix.reduce_row_elements("prod")
    assert product.to_local().tolist() == [[6.0], [-9.0], [0.0], [0.0]]
    assert product.dim == (4, 1)
    sums = {row.row_id: row.value for row in matrix.row_sums().collect()}
    assert sums == {0: 6.0, 1: 9.0, 2: 1.0, 3: 1.0}


@pytest.mark.parametrize("layout", LAYOUTS)
def test_column_product_and_sums(spark, layout):
    matrix = layout(spark, M2)
    product = matrix.reduce_col_elements("prod")
    assert product.to_local().tolist() == [[1618.0, 0.0, -12.0]]
    assert product.dim == (1, 3)
    assert [row.value for row in matrix.col_sums().orderBy("j").collect()] == [1621.0, 12.0, 7.0]


@pytest.mark.parametrize("layout", LAYOUTS)
@pytest.mark.parametrize(
    "rows, cols",
    [
        (slice(None), slice(1, 2)),
        (slice(None), slice(1, 3)),
        (slice(1, 2), slice(None)),
        (slice(0, 5), slice(None)),
        (slice(2, 3), slice(1, 2)),
        (slice(2, 3), slice(1, 3)),
        (slice(2, 2), slice(1, 3)),
        (slice(7, 9), slice(None)),
    ],
)
def test_slices(spark, layout, rows, cols):
    part = layout(spark, M4)[rows, cols]
    expected = M4[rows, cols]
    assert part.dim == expected.shape
    assert part.to_local().tolist() == expected.tolist()


def test_slice_rejects_steps_and_negative_positions(spark):
    matrix = rows_of(spark, M4)
    with pytest.raises(ValueError):
        matrix[0:4:2, :]
    with pytest.raises(ValueError):
        matrix[-1:, :]


def test_column_slice_prunes_the_scan_and_rows_reach_it(spark, folder):
    parts = spark.read.parquet(f"{folder}/part.parquet")
    lines = spark.read.parquet(f"{folder}/lineitem.parquet")
    numbers = from_columns(lines, ["l_quantity", "l_discount", "l_tax"])
    plan = numbers[:, 1:2].base._jdf.queryExecution().executedPlan().toString()
    assert "l_discount" in plan and "l_quantity" not in plan and "l_tax" not in plan
    rows = from_columns(parts, ["p_retailprice"], row_id="p_partkey")[10:20, :]
    plan = rows.base._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(p_partkey,10)" in plan and "LessThan(p_partkey,20)" in plan


def test_collect_many_partitions_keeps_order(spark):
    matrix = random_uniform(spark, 10000, 10, seed=1, partitions=200)
    local = matrix.to_local()
    keyed = {row.row_id: row.vec for row in matrix.df.filter("row_id % 997 = 0").collect()}
    assert local.shape == (10000, 10)
    assert all(local[i].tolist() == vec for i, vec in keyed.items())


@pytest.mark.parametrize("layout", LAYOUTS)
def test_element_wise(spark, layout):
    array = np.array([[1.5, -2.0], [0.0, 4.0], [3.0, 9.0]])
    matrix = layout(spark, array)
    assert np.array_equal((matrix + 2).to_local(), array + 2)
    assert np.array_equal((matrix - 2).to_local(), array - 2)
    assert np.array_equal((matrix * 3).to_local(), array * 3)
    assert np.array_equal((matrix / 3).to_local(), array * (1.0 / 3))
    assert np.array_equal(matrix.pow(2).to_local(), array**2)
    assert np.array_equal(matrix.map_elements(F.abs).to_local(), np.abs(array))
    assert np.array_equal(matrix.map_numpy(np.square).to_local(), array**2)
    divided = (matrix / 0).to_local()
    assert divided[0, 0] == np.inf and divided[0, 1] == -np.inf and np.isnan(divided[1, 0])
    assert np.isnan(matrix.pow(0.5).to_local()[0, 1])


def test_matrix_plus_and_minus(spark):
    a, b = rows_of(spark, M1, 2), wide_of(spark, M4, 7)
    assert np.array_equal((a + b).to_local(), M1 + M4)
    assert np.array_equal((a - b).to_local(), M1 - M4)
    with pytest.raises(ValueError):
        a + rows_of(spark, M1[:, :2])
    with pytest.raises(ValueError):
        a + rows_of(spark, M1[:3])
    with pytest.raises(TypeError):
        a + "matrix"


def test_addition_finds_missing_rows_while_running(spark):
    left = rows_of(spark, M1)
    right = left.replace(left.base.filter("row_id != 2"), left.cells, n_rows=None)
    with pytest.raises(RUN_ERRORS, match="unequal size"):
        (left + right).to_local()


def test_whole_matrix_reductions(spark):
    for matrix in (rows_of(spark, M2), wide_of(spark, M2)):
        assert matrix.reduce_elements("sum") == M2.sum()
        assert matrix.reduce_elements("min") == M2.min()
        assert matrix.reduce_elements("max") == M2.max()
        assert (matrix + 1.5).reduce_elements("prod") == pytest.approx((M2 + 1.5).prod())
        assert matrix.norm_frobenius() == pytest.approx(np.linalg.norm(M2))
        assert matrix.reduce_elements(np.hypot) == pytest.approx(np.linalg.norm(M2))
    with pytest.raises(ValueError):
        rows_of(spark, M2).reduce_elements("median")


def test_custom_reducers_and_fold(spark):
    array = np.random.default_rng(3).normal(size=(57, 5))
    matrix = rows_of(spark, array, 6)
    assert np.allclose(matrix.reduce_col_elements(np.hypot).to_local()[0], np.hypot.reduce(array))
    assert np.allclose(matrix.reduce_row_elements(np.hypot).to_local()[:, 0], np.hypot.reduce(array, axis=1))
    count, total = matrix.aggregate_elements(
        (0, 0.0),
        lambda s, x: (s[0] + int((x > 0).sum()), s[1] + float(x.sum())),
        lambda s, t: (s[0] + t[0], s[1] + t[1]),
        "n bigint, total double",
    )
    assert count == (array > 0).sum() and total == pytest.approx(array.sum())


def test_wide_matrix_column_sums_beyond_generated_code(spark):
    array = np.random.default_rng(4).normal(size=(30, 90))
    sums = {row.j: row.value for row in rows_of(spark, array).col_sums().collect()}
    assert np.allclose([sums[j] for j in range(90)], array.sum(axis=0))


def test_strip_maps(spark):
    array = np.arange(46, dtype=float).reshape(23, 2)
    matrix = rows_of(spark, array, 5)
    centred = matrix.map_strips(lambda rows: rows - rows.mean(axis=0), 5).to_local()
    assert np.allclose(centred[20:], array[20:] - array[20:].mean(axis=0))
    shrunk = matrix.map_strips(lambda rows: rows.sum(axis=1)[None, :2], 5, keep_rows=False).to_local()
    assert np.allclose(shrunk, np.vstack([array[i : i + 5].sum(axis=1)[:2] for i in range(0, 23, 5)]))


def test_strips_of_unequal_height_are_stacked_in_order(spark):
    strips = spark.createDataFrame(
        [(9, 1, 2, [7.0, 8.0]), (2, 2, 2, [1.0, 2.0, 3.0, 4.0]), (5, 0, 0, []), (7, 1, 2, [5.0, 6.0])],
        "strip_id bigint, n_rows int, n_cols int, vals array<double>",
    )
    assert from_strips(strips).to_local().tolist() == [[1, 2], [3, 4], [5, 6], [7, 8]]
    single = spark.createDataFrame([(0, 2, 1, [1.0, 2.0]), (1, 0, 1, [])], strips.schema)
    assert from_strips(single).to_local().tolist() == [[1], [2]]


def test_strip_directory_over_many_buckets(spark):
    keys = spark.range(20000).select(F.col("id").alias("row_id"), F.lit(1.0).alias("x"))
    directory = from_columns(keys, ["x"], "row_id").strip_directory(2)
    assert directory.filter("start_row != 2 * strip_id or n_rows != 2").count() == 0
    assert directory.count() == 10000


def test_dims_and_length(spark):
    matrix = wide_of(spark, M1)
    assert matrix.dim == (4, 3) and matrix.length() == 12
    assert shape.dims(matrix).head().asDict() == {"n_rows": 4, "n_cols": 3}


def test_nulls_and_types(spark):
    frame = spark.createDataFrame([(0, 1.0), (1, None)], "row_id bigint, x double")
    assert from_columns(frame, ["x"], "row_id", nulls="zero").to_local().tolist() == [[1.0], [0.0]]
    with pytest.raises(RUN_ERRORS, match="NULL in matrix column x"):
        from_columns(frame, ["x"], "row_id").to_local()
    with pytest.raises(ValueError, match="DOUBLE"):
        from_columns(frame.withColumn("x", F.col("x").cast("int")), ["x"], "row_id")
    ragged = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0])], "row_id bigint, v array<double>")
    with pytest.raises(RUN_ERRORS, match="must hold 2 numbers"):
        from_arrays(ragged, "v", "row_id", n_cols=2).to_local()
    with pytest.raises(ValueError, match="row identity"):
        from_columns(frame.select(F.lit(1.0).alias("x")), ["x"]).to_long()


def test_empty_matrix(spark):
    empty = rows_of(spark, M1)[9:9, :]
    assert empty.to_local().shape == (0, 3)
    assert empty.norm_frobenius() == 0.0
    assert empty.reduce_elements("sum") == 0.0 and empty.reduce_elements("prod") == 1.0
    assert empty.col_sums().count() == 0 and empty.gram().count() == 0 and empty.qr_r().count() == 0


def test_random_matrices_are_keyed(spark):
    a = random_uniform(spark, 500, 6, seed=5, partitions=3).to_local()
    b = random_uniform(spark, 500, 6, seed=5, partitions=11).to_local()
    assert np.array_equal(a, b) and a.min() >= 0 and a.max() < 1 and abs(a.mean() - 0.5) < 0.02
    assert not np.array_equal(a, random_uniform(spark, 500, 6, seed=6).to_local())
    normal = random_normal(spark, 2000, 5, seed=5).to_local()
    assert abs(normal.mean()) < 0.05 and abs(normal.std() - 1) < 0.05


def test_closeness_sees_large_negative_differences(spark):
    matrix = rows_of(spark, M1)
    assert about_equal(matrix, matrix + 1e-10).head().close is True
    assert about_equal(matrix, matrix + 10.0).head().close is False


def test_co_partitioned_matrices_join_without_another_shuffle(spark):
    base = spark.range(1, 11).select((F.col("id") - 1).alias("row_id"), F.col("id").cast("double").alias("x"))
    first = from_columns(base.repartition(5), ["x"], "row_id")
    second = first + 10.0
    left, right = co_partition([first, second], 2)
    gap = right - left
    assert set(gap.to_local().ravel()) == {10.0}
    plan = gap.base._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2 and "REPARTITION_BY_NUM" in plan


def test_gram_routes_agree(spark):
    array = np.random.default_rng(1).normal(size=(211, 12))
    matrix = rows_of(spark, array)
    gram = {(row.i, row.j): row.value for row in matrix.gram().collect()}
    narrow = {(row.i, row.j): row.value for row in matrix[:, 0:5].gram().collect()}
    expected = array.T @ array
    assert np.allclose([[gram[i, j] for j in range(12)] for i in range(12)], expected)
    assert np.allclose([[narrow[i, j] for j in range(5)] for i in range(5)], expected[:5, :5])


def test_times_local_routes(spark):
    array = np.random.default_rng(2).normal(size=(40, 20))
    matrix = rows_of(spark, array)
    for width in (2, 30):
        local = np.random.default_rng(width).normal(size=(20, width))
        assert np.allclose(matrix.times_local(local).to_local(), array @ local)
    with pytest.raises(ValueError):
        matrix.times_local(np.ones((3, 3)))


def test_cache_round_trip(spark):
    matrix = rows_of(spark, M1).cache()
    assert matrix.base.is_cached
    assert not matrix.unpersist().base.is_cached
    assert isinstance(matrix.reduce_row_elements("sum").cells, Wide)
    assert reductions.norm_frobenius(matrix).columns == ["value"]
