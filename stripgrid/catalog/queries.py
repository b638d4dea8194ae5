"""Every operator as a query over the given tables. Each takes ``(spark, folder)`` and returns a DataFrame."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..block_matrix import BlockMatrix
from ..functions.lineage import ensure_checkpoint_dir
from ..layout import Packed
from ..operators import block_products, products, reductions, shape
from ..plans.block_descent import BlockCoordinateDescent
from ..plans.compare import about_equal, co_partition, max_difference
from ..plans.least_squares import (
    GradientDescent,
    NormalEquations,
    QrTree,
    System,
    relative_error,
    residual_norm,
    solution_array,
)
from ..plans.systems import accuracy_report, linear_systems
from ..plans.tall_qr import condition_numbers, r_long, singular_values, svd, thin_qr, two_norm
from ..row_matrix import RowMatrix
from ..sources import storage
from ..sources.grids import from_blocks, from_column_parts, stack_columns, to_grid
from ..sources.random import normal_for, uniform_for
from ..sources.tables import from_arrays, from_columns, from_strips

Query = Callable[[SparkSession, str], DataFrame]

STRIP = 64
GRID = (37, 10)
LAMBDAS = [0.0, 10.0, 1000.0]
SGD_STEPS, SGD_RATE = 20, 0.5
DESCENTS = 6

QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


# -- inputs --------------------------------------------------------------------------------------------------


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def part_matrix(spark: SparkSession, folder: str) -> RowMatrix:
    parts = table(spark, folder, "part")
    sized = parts.select("p_partkey", F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("price"))
    return from_columns(sized, ["size", "price"], row_id="p_partkey")


def embedding_matrix(spark: SparkSession, folder: str) -> RowMatrix:
    return from_arrays(table(spark, folder, "embeddings"), "embedding", row_id="vec_id")


def embedding_grid(spark: SparkSession, folder: str) -> BlockMatrix:
    return to_grid(embedding_matrix(spark, folder), *GRID)


def line_measures(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem")
    return lines.select(
        F.lit(1.0).alias("one"),
        F.col("l_quantity").alias("qty"),
        F.rint(F.col("l_discount") * 100).alias("disc"),
        F.rint(F.col("l_tax") * 100).alias("tax"),
        F.col("l_linenumber").cast("double").alias("line"),
        (F.col("l_extendedprice") / 1000).alias("price"),
    )


def order_measures(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders")
    return orders.select(
        "o_orderkey",
        F.lit(1.0).alias("one"),
        (F.col("o_totalprice") / 100000).alias("price"),
        (F.col("o_custkey") % 7).cast("double").alias("group7"),
    )


def order_system(spark: SparkSession, folder: str) -> System:
    return System.from_columns(order_measures(spark, folder), ["one", "group7"], ["price"], row_id="o_orderkey")


def line_system(spark: SparkSession, folder: str, features=("one", "qty", "disc"), targets=("price",)) -> System:
    return System.from_columns(line_measures(spark, folder), list(features), list(targets))


def neat(value: Column | str, digits: int) -> Column:
    """Rounded, with negative zero turned into zero."""
    column = F.col(value) if isinstance(value, str) else value
    return F.round(column, digits) + F.lit(0.0)


def rounded(frame: DataFrame, digits: int, *names: str) -> DataFrame:
    return frame.withColumns({name: neat(name, digits) for name in names or ("value",)})


def middle_half(size: int) -> slice:
    return slice(size // 4, 3 * (size // 4))


# -- sources, sinks, shape -----------------------------------------------------------------------------------


@query
def from_table(spark, folder):
    return part_matrix(spark, folder).to_long()


@query
def from_table_known_size(spark, folder):
    parts = table(spark, folder, "part").select("p_partkey", "p_retailprice")
    sized = from_columns(parts, ["p_retailprice"], row_id="p_partkey", n_rows=parts.count())
    return sized.to_long()


@query
def from_table_null_as_zero(spark, folder):
    """Prices of small parts are NULL on input and count as zero."""
    parts = table(spark, folder, "part")
    holes = parts.select("p_partkey", F.when(F.col("p_size") > 25, F.col("p_retailprice")).alias("price"))
    return from_columns(holes, ["price"], row_id="p_partkey", nulls="zero").to_long()


@query
def from_array(spark, folder):
    return embedding_matrix(spark, folder).to_long()


@query
def from_array_known_size(spark, folder):
    vectors = table(spark, folder, "embeddings")
    return from_arrays(vectors, "embedding", row_id="vec_id", n_cols=64, n_rows=vectors.count()).to_long()


@query
def from_strip_blocks(spark, folder):
    strips = shape.map_strips_to_strips(embedding_matrix(spark, folder), lambda rows: rows, STRIP)
    return from_strips(strips, n_cols=64).to_long()


@query
def column_blocks(spark, folder):
    """Three column blocks of different widths, each a matrix of its own, side by side in one grid."""
    matrix = embedding_matrix(spark, folder)
    return stack_columns([matrix[:, 0:5], matrix[:, 5:40], matrix[:, 40:64]], 37).to_long()


@query
def column_parts(spark, folder):
    """The same from one table partitioned by columns."""
    vectors = table(spark, folder, "embeddings")
    cut = F.posexplode(F.array(*[F.slice("embedding", 16 * p + 1, 16) for p in range(4)])).alias("part", "piece")
    grid = from_column_parts(vectors.select("vec_id", cut), "part", "vec_id", "piece", 50, parts=range(4))
    return grid[:, 8:56].to_long()


def _scratch(spark, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query
def stored_blocks_slice(spark, folder):
    """Blocks written and read again; the slice becomes bounds on block ids."""
    path = _scratch(spark, "blocks")
    storage.write_blocks(embedding_grid(spark, folder), path)
    grid = storage.read_blocks(spark, path)
    return grid[middle_half(grid.n_rows), 8:24].to_long()


@query
def stored_rows_slice(spark, folder):
    path = _scratch(spark, "rows")
    matrix = embedding_matrix(spark, folder)
    storage.write_rows(matrix, path)
    return storage.read_rows(spark, path, n_cols=64)[middle_half(matrix.n_rows), 8:24].to_long()


@query
def block_grid(spark, folder):
    grid = embedding_grid(spark, folder)
    total = F.aggregate("vals", F.lit(0.0), lambda s, x: s + x)
    return grid.df.select("block_row", "block_col", "n_rows", "n_cols", neat(total, 6).alias("block_sum"))


@query
def grid_from_blocks(spark, folder):
    blocks = embedding_grid(spark, folder).df.select("block_row", "block_col", "n_rows", "n_cols", "vals")
    return from_blocks(blocks).to_long()


@query
def to_long(spark, folder):
    return rounded(part_matrix(spark, folder).to_long(), 4)


@query
def block_to_long(spark, folder):
    return embedding_grid(spark, folder).to_long()


@query
def dims(spark, folder):
    return shape.dims(part_matrix(spark, folder)).select("n_rows", F.col("n_cols").cast("bigint").alias("n_cols"))


@query
def block_dims(spark, folder):
    return embedding_grid(spark, folder).dims()


@query
def strip_dir(spark, folder):
    return part_matrix(spark, folder).strip_directory(STRIP)


@query
def block_dir(spark, folder):
    return embedding_grid(spark, folder).directory()


# -- element-wise --------------------------------------------------------------------------------------------


@query
def elem_add(spark, folder):
    return rounded((part_matrix(spark, folder) + 2.5).to_long(), 6)


@query
def elem_sub(spark, folder):
    return rounded((part_matrix(spark, folder) - 2.5).to_long(), 6)


@query
def elem_mul(spark, folder):
    return rounded((part_matrix(spark, folder) * 1.5).to_long(), 6)


@query
def elem_div(spark, folder):
    return rounded((part_matrix(spark, folder) / 7.0).to_long(), 6)


@query
def elem_pow(spark, folder):
    return rounded(part_matrix(spark, folder).pow(1.5).to_long(), 4)


@query
def elem_map(spark, folder):
    return rounded(part_matrix(spark, folder).map_elements(lambda x: F.sqrt(x) - F.cos(x)).to_long(), 6)


@query
def elem_map_numpy(spark, folder):
    return rounded(embedding_matrix(spark, folder).map_numpy(np.tanh).to_long(), 8)


@query
def block_elem_scalar(spark, folder):
    return rounded((((embedding_grid(spark, folder) + 1.0) * 3.0 - 0.5) / 7.0).pow(2.0).to_long(), 8)


@query
def block_elem_map(spark, folder):
    return rounded(embedding_grid(spark, folder).map_elements(lambda x: F.signum(x) * F.sqrt(F.abs(x))).to_long(), 8)


@query
def strip_map(spark, folder):
    centred = embedding_matrix(spark, folder).map_strips(lambda rows: rows - rows.mean(axis=0), STRIP)
    return rounded(centred.to_long(), 9)


@query
def strip_map_resize(spark, folder):
    means = embedding_matrix(spark, folder).map_strips(lambda rows: rows.mean(axis=0), STRIP, keep_rows=False)
    return rounded(means.to_long(), 9)


def local_weights(rows: int) -> np.ndarray:
    j = np.arange(rows)
    return np.stack([j % 5 - 2.0, 1.0 / (j + 1.0)], axis=1)


@query
def mat_times_local(spark, folder):
    return rounded(embedding_matrix(spark, folder).times_local(local_weights(64)).to_long(), 8)


@query
def mat_times_local_wide(spark, folder):
    weights = np.outer(np.arange(64) % 5 - 2.0, np.arange(16) + 1.0)
    return rounded(embedding_matrix(spark, folder).times_local(weights).to_long(), 7)


# -- selection -----------------------------------------------------------------------------------------------


@query
def slice_rows(spark, folder):
    matrix = embedding_matrix(spark, folder)
    return matrix[middle_half(matrix.n_rows), :].to_long()


@query
def slice_cols(spark, folder):
    return embedding_matrix(spark, folder)[:, 8:24].to_long()


@query
def slice_both(spark, folder):
    matrix = embedding_matrix(spark, folder)
    return matrix[middle_half(matrix.n_rows), 8:24].to_long()


@query
def slice_wide(spark, folder):
    matrix = part_matrix(spark, folder)
    return matrix[middle_half(matrix.n_rows), 1:2].to_long()


@query
def block_slice_rows(spark, folder):
    grid = embedding_grid(spark, folder)
    return grid[middle_half(grid.n_rows), :].to_long()


@query
def block_slice_cols(spark, folder):
    return embedding_grid(spark, folder)[:, 8:24].to_long()


@query
def block_slice_both(spark, folder):
    grid = embedding_grid(spark, folder)
    return grid[middle_half(grid.n_rows), 8:24].to_long()


@query
def block_slice_dir(spark, folder):
    """Positions of the blocks left by a slice, renumbered from zero."""
    grid = embedding_grid(spark, folder)
    return grid[middle_half(grid.n_rows), 8:24].directory()


@query
def block_range(spark, folder):
    grid = embedding_grid(spark, folder)
    blocks = -(-grid.n_rows // GRID[0])
    return grid.block_range(blocks // 4, blocks, 1, 4).to_long()


@query
def col_block(spark, folder):
    return embedding_grid(spark, folder).col_block(6).to_long()


# -- matrix with matrix --------------------------------------------------------------------------------------


@query
def mat_add(spark, folder):
    matrix = embedding_matrix(spark, folder)
    return rounded((matrix + matrix * 2.0).to_long(), 8)


@query
def mat_sub(spark, folder):
    matrix = embedding_matrix(spark, folder)
    return rounded((matrix - (matrix + 1.0)).to_long(), 8)


@query
def block_add(spark, folder):
    grid = embedding_grid(spark, folder)
    return rounded((grid + grid * 2.0).to_long(), 8)


@query
def block_sub(spark, folder):
    grid = embedding_grid(spark, folder)
    return rounded((grid - (grid + 1.0)).to_long(), 8)


@query
def matrix_close(spark, folder):
    matrix = embedding_matrix(spark, folder)
    return rounded(about_equal(matrix, matrix + 0.25, tolerance=0.5), 8, "max_abs_diff")


@query
def matrix_not_close(spark, folder):
    """A large negative difference must be seen."""
    matrix = embedding_matrix(spark, folder)
    return rounded(about_equal(matrix, matrix + 4.0), 8, "max_abs_diff")


@query
def co_partitioned_difference(spark, folder):
    prices = from_columns(order_measures(spark, folder), ["price"], row_id="o_orderkey")
    left, right = co_partition([prices, prices + 10.0], 8)
    return rounded((right - left).to_long(), 8)


# -- reductions ----------------------------------------------------------------------------------------------


def _row_reduction(op: str) -> Query:
    def run(spark, folder):
        return rounded(reductions.row_values(part_matrix(spark, folder), op), 4)

    return run


def _row_reduction_packed(op: str) -> Query:
    def run(spark, folder):
        shifted = embedding_matrix(spark, folder) + 1.0
        return rounded(reductions.row_values(shifted, op), 8)

    return run


def _col_reduction(op: str) -> Query:
    def run(spark, folder):
        return rounded(reductions.col_values(embedding_matrix(spark, folder) * 0.01 + 1.0, op), 8)

    return run


def _all_reduction(op: str) -> Query:
    def run(spark, folder):
        return rounded(reductions.all_values(embedding_matrix(spark, folder) * 0.01 + 1.0, op), 6)

    return run


def _block_row_reduction(op: str) -> Query:
    def run(spark, folder):
        reduced = (embedding_grid(spark, folder) + 1.0).reduce_row_elements(op)
        return rounded(reduced.to_long().select(F.col("i").alias("row_id"), "value"), 8)

    return run


def _block_col_reduction(op: str) -> Query:
    def run(spark, folder):
        reduced = (embedding_grid(spark, folder) * 0.01 + 1.0).reduce_col_elements(op)
        return rounded(reduced.to_long().select("j", "value"), 8)

    return run


for _op in ("sum", "prod", "min", "max"):
    QUERIES[f"row_{_op}"] = _row_reduction(_op)
    QUERIES[f"row_{_op}_array"] = _row_reduction_packed(_op)
    QUERIES[f"col_{_op}"] = _col_reduction(_op)
    QUERIES[f"reduce_all_{_op}"] = _all_reduction(_op)
    QUERIES[f"block_row_{_op}"] = _block_row_reduction(_op)
    QUERIES[f"block_col_{_op}"] = _block_col_reduction(_op)


@query
def col_sum_events(spark, folder):
    """Column sums of a long, narrow table."""
    values = from_columns(table(spark, folder, "events"), ["value"], row_id="event_id")
    return rounded(values.col_sums(), 4)


@query
def row_reduce_custom(spark, folder):
    return rounded(reductions.row_values(embedding_matrix(spark, folder), np.hypot), 8)


@query
def col_reduce_custom(spark, folder):
    return rounded(reductions.col_values(embedding_matrix(spark, folder), np.hypot), 8)


@query
def block_col_reduce_custom(spark, folder):
    reduced = embedding_grid(spark, folder).reduce_col_elements(np.hypot)
    return rounded(reduced.to_long().select("j", "value"), 8)


@query
def block_row_reduce_custom(spark, folder):
    reduced = embedding_grid(spark, folder).reduce_row_elements(np.hypot)
    return rounded(reduced.to_long().select(F.col("i").alias("row_id"), "value"), 8)


@query
def agg_fold(spark, folder):
    """Custom fold: count, sum and largest absolute value of all elements."""
    state = reductions.fold_elements(
        embedding_matrix(spark, folder),
        (0, 0.0, 0.0),
        lambda s, x: (s[0] + len(x), s[1] + float(x.sum()), max(s[2], float(np.abs(x).max()))),
        lambda s, t: (s[0] + t[0], s[1] + t[1], max(s[2], t[2])),
        "n bigint, total double, largest double",
    )
    return rounded(state, 8, "total", "largest")


@query
def norm_fro(spark, folder):
    prices = from_columns(line_measures(spark, folder), ["qty", "price"])
    return rounded(reductions.norm_frobenius(prices), 4)


@query
def norm_fro_array(spark, folder):
    return rounded(reductions.norm_frobenius(embedding_matrix(spark, folder)), 8)


@query
def block_norm_fro(spark, folder):
    return rounded(embedding_grid(spark, folder).norm_frame(), 8)


# -- products ------------------------------------------------------------------------------------------------


@query
def gram(spark, folder):
    matrix = from_columns(line_measures(spark, folder), ["one", "qty", "line", "disc", "tax"])
    return matrix.gram()


@query
def gram_wide(spark, folder):
    return rounded(embedding_matrix(spark, folder).gram(), 7)


@query
def gram_many_rhs(spark, folder):
    """Gram and cross products of features with two targets, side by side."""
    system = line_system(spark, folder, ("one", "qty", "disc"), ("tax", "line"))
    both = products.gram_long(system.base, [system.a, system.b])
    return both.filter("i < 3")


@query
def gram_tiles(spark, folder):
    """The route for very wide matrices, in tiles of 24 columns."""
    matrix = embedding_matrix(spark, folder)
    blocks = block_products.gram_blocks(matrix.base, [matrix.cells], tile=24)
    return rounded(block_products.gram_cells(blocks), 7)


def _embedding_gram(spark, folder) -> BlockMatrix:
    """E'E from a transposed grid times the grid, in result tiles of 40 lines."""
    grid = embedding_grid(spark, folder)
    return grid.T.multiply(grid, tile=40)


@query
def block_mul(spark, folder):
    return rounded(_embedding_gram(spark, folder).to_long(), 7)


@query
def mat_mul(spark, folder):
    """Rows times blocks: E (E'E)."""
    product = embedding_matrix(spark, folder).multiply(_embedding_gram(spark, folder), tile=300)
    return rounded(product.to_long(), 6)


@query
def mat_mul_rows(spark, folder):
    """Rows times rows."""
    product = embedding_matrix(spark, folder) @ _embedding_gram(spark, folder).to_rows()
    return rounded(product.to_long(), 6)


@query
def block_transpose(spark, folder):
    return embedding_grid(spark, folder).T.to_long()


@query
def mat_transpose(spark, folder):
    return embedding_matrix(spark, folder).transpose(16, 100).to_long()


@query
def transpose_twice(spark, folder):
    return embedding_matrix(spark, folder).transpose(16, 100).to_rows().transpose(100, 16).to_long()


# -- factorisations ------------------------------------------------------------------------------------------


@query
def tsqr_r(spark, folder):
    return rounded(r_long(from_columns(line_measures(spark, folder), ["qty", "line", "disc"])), 4)


def _order_matrix(spark, folder) -> RowMatrix:
    return from_columns(order_measures(spark, folder), ["one", "price", "group7"], row_id="o_orderkey")


@query
def tsqr_q(spark, folder):
    return rounded(thin_qr(_order_matrix(spark, folder)).q.to_long(), 9)


@query
def tsqr_q_direct(spark, folder):
    return rounded(thin_qr(_order_matrix(spark, folder), route="direct").q.to_long(), 9)


@query
def tsqr_q_checks(spark, folder):
    """Largest entries of Q'Q - I and of A - QR."""
    matrix = _order_matrix(spark, folder)
    factor = thin_qr(matrix)
    identity = F.when(F.col("i") == F.col("j"), 1.0).otherwise(0.0)
    orthogonality = factor.q.gram().agg(F.max(F.abs(F.col("value") - identity)).alias("off"))
    rebuilt = max_difference(matrix, factor.q.times_local(factor.r))
    checks = [orthogonality.select(F.lit("orthogonality").alias("check"), neat("off", 9).alias("value"))]
    checks.append(rebuilt.select(F.lit("reconstruction").alias("check"), neat("max_abs_diff", 9).alias("value")))
    return checks[0].unionByName(checks[1])


@query
def cond_numbers(spark, folder):
    return rounded(condition_numbers(from_columns(line_measures(spark, folder), ["qty", "disc"])), 6, "cond_1", "cond_2")


@query
def svd_values(spark, folder):
    return rounded(singular_values(from_columns(line_measures(spark, folder), ["qty", "disc"])), 4, "sigma")


def _order_pair(spark, folder) -> RowMatrix:
    return from_columns(order_measures(spark, folder), ["price", "group7"], row_id="o_orderkey")


@query
def svd_u(spark, folder):
    return rounded(svd(_order_pair(spark, folder)).u.to_long(), 9)


@query
def svd_u_direct(spark, folder):
    return rounded(svd(_order_pair(spark, folder), route="direct").u.to_long(), 9)


@query
def svd_v(spark, folder):
    return rounded(svd(_order_pair(spark, folder)).v_long(), 9)


@query
def svd_truncated(spark, folder):
    """The best approximation of rank 1, U S V'."""
    part = svd(_order_pair(spark, folder), rank=1)
    return rounded(part.u.times_local(part.sigma[:, None] * part.v.T).to_long(), 7)


@query
def svd_checks(spark, folder):
    """All 64 columns: largest entries of U'U - I, V'V - I and A - U S V'; and the rank found for three columns of which one
    is a combination of the others."""
    matrix = embedding_matrix(spark, folder)
    whole = svd(matrix)
    identity = F.when(F.col("i") == F.col("j"), 1.0).otherwise(0.0)
    left = whole.u.gram().agg(F.max(F.abs(F.col("value") - identity)).alias("value"))
    rebuilt = max_difference(matrix, whole.u.times_local(whole.sigma[:, None] * whole.v.T))
    right = float(np.abs(whole.v.T @ whole.v - np.eye(len(whole.sigma))).max())
    measures = order_measures(spark, folder).withColumn("mixed", F.col("one") * 2.0 + F.col("group7"))
    rank = len(svd(from_columns(measures, ["one", "group7", "mixed"], row_id="o_orderkey")).sigma)
    checks = left.select(F.lit("left").alias("check"), neat("value", 9).alias("value"))
    checks = checks.unionByName(rebuilt.select(F.lit("rebuilt").alias("check"), neat("max_abs_diff", 9).alias("value")))
    local = spark.createDataFrame([("right", right), ("rank", float(rank))], "check string, value double")
    return checks.unionByName(rounded(local, 9))


@query
def norm_two(spark, folder):
    return rounded(two_norm(from_columns(line_measures(spark, folder), ["qty", "disc"])), 4)


@query
def block_qr_r(spark, folder):
    grid = to_grid(embedding_matrix(spark, folder)[:, 0:6], 100, 2)
    return rounded(grid.qr_r().to_long().filter("j >= i"), 8)


@query
def block_qr_gram(spark, folder):
    """R'R for the R of all columns. R is upper triangular with a positive diagonal, so R'R = A'A settles it."""
    r = to_grid(embedding_matrix(spark, folder), 100, 16).qr_r()
    return rounded(r.to_rows().gram(), 7)


@query
def block_to_rows(spark, folder):
    return embedding_grid(spark, folder).to_rows().to_long()


# -- solvers -------------------------------------------------------------------------------------------------


@query
def lsq_normal(spark, folder):
    return rounded(NormalEquations().solve(line_system(spark, folder)), 7, "x")


@query
def lsq_tsqr(spark, folder):
    return rounded(QrTree().solve(line_system(spark, folder)), 7, "x")


@query
def ridge_normal(spark, folder):
    return rounded(NormalEquations().solve_many_l2(line_system(spark, folder), LAMBDAS), 7, "x")


@query
def ridge_tsqr(spark, folder):
    return rounded(QrTree().solve_many_l2(line_system(spark, folder), LAMBDAS), 7, "x")


@query
def ridge_many_rhs(spark, folder):
    system = line_system(spark, folder, targets=("price", "tax"))
    return rounded(QrTree().solve_many_l2(system, LAMBDAS), 7, "x")


@query
def ridge_aligned(spark, folder):
    """A and b as two matrices, joined on the row key."""
    measures = order_measures(spark, folder)
    a = from_columns(measures, ["one", "group7"], row_id="o_orderkey")
    b = from_columns(measures, ["price"], row_id="o_orderkey")
    return rounded(NormalEquations().solve_l2(System.align(a, b), 10.0), 7, "x")


def _with_residuals(spark, folder) -> tuple[System, Packed]:
    """One residual column per penalty: 0.5 qty for the first, tax for the second."""
    system = line_system(spark, folder, targets=("price", "tax"))
    offsets = F.array(F.col("qty") * 0.5, F.lit(0.0), F.col("tax"), F.col("one"))
    base = system.base.withColumn("residuals", offsets)
    return System(base, system.a, system.b), Packed("residuals", 4)


@query
def lsq_many_targets_normal(spark, folder):
    system, residuals = _with_residuals(spark, folder)
    return rounded(NormalEquations().solve_targets_l2(system, residuals, [0.0, 10.0]), 7, "x")


@query
def lsq_many_targets_tsqr(spark, folder):
    system, residuals = _with_residuals(spark, folder)
    return rounded(QrTree().solve_targets_l2(system, residuals, [0.0, 10.0]), 7, "x")


def _sgd_system(spark, folder) -> System:
    lines = table(spark, folder, "lineitem")
    scaled = lines.select(
        (F.col("l_discount") * 10).alias("disc"),
        (F.col("l_tax") * 10).alias("tax"),
        (F.col("l_extendedprice") / 100000).alias("price"),
    )
    return System.from_columns(scaled, ["disc", "tax"], ["price"])


@query
def sgd_ls(spark, folder):
    return rounded(GradientDescent(SGD_STEPS, SGD_RATE).solve(_sgd_system(spark, folder)), 9, "x")


@query
def sgd_ridge(spark, folder):
    return rounded(GradientDescent(SGD_STEPS, SGD_RATE).solve_many_l2(_sgd_system(spark, folder), [0.0, 0.1]), 9, "x")


@query
def sgd_targets(spark, folder):
    system = _sgd_system(spark, folder)
    base = system.base.withColumn("residuals", F.array(F.col("tax") * 0.5, F.col("disc") * 0.25))
    shifted = System(base, system.a, system.b)
    solver = GradientDescent(SGD_STEPS, SGD_RATE)
    return rounded(solver.solve_targets_l2(shifted, Packed("residuals", 2), [0.0, 0.1]), 9, "x")


@query
def sgd_mini_batch(spark, folder):
    """Keyed samples of half the rows per step, all steps from one pass."""
    system = order_system(spark, folder)
    solver = GradientDescent(SGD_STEPS, 0.05, batch_fraction=0.5)
    return rounded(solver.solve_many_l2(system, [0.0, 0.1]), 9, "x")


@query
def sgd_mini_batch_wide(spark, folder):
    """Sampled steps on a matrix too wide for compiled sums."""
    matrix = embedding_matrix(spark, folder)
    solver = GradientDescent(5, 0.5, batch_fraction=0.5)
    return rounded(solver.solve_l2(System.align(matrix[:, 1:64], matrix[:, 0:1]), 0.1), 9, "x")


@query
def sgd_by_steps(spark, folder):
    """The route for very wide matrices: one gradient pass per step."""
    solver = GradientDescent(5, SGD_RATE)
    steps = solver.solve_by_steps(_sgd_system(spark, folder), [0.1], [range(1)])
    return rounded(steps.drop("target"), 9, "x")


@query
def bcd_normal(spark, folder):
    descent = BlockCoordinateDescent(NormalEquations(), DESCENTS)
    return rounded(descent.solve_columns(line_system(spark, folder), [1, 1, 1], [0.0, 10.0]), 7, "x")


@query
def bcd_tsqr(spark, folder):
    descent = BlockCoordinateDescent(QrTree(), DESCENTS)
    return rounded(descent.solve_columns(line_system(spark, folder), [1, 1, 1], [0.0, 10.0]), 7, "x")


def _order_blocks(spark, folder) -> tuple[list[RowMatrix], RowMatrix]:
    measures = order_measures(spark, folder)
    blocks = [from_columns(measures, [name], row_id="o_orderkey") for name in ("one", "group7")]
    return blocks, from_columns(measures, ["price"], row_id="o_orderkey")


@query
def bcd_streaming(spark, folder):
    blocks, b = _order_blocks(spark, folder)
    descent = BlockCoordinateDescent(NormalEquations(), 2)
    return rounded(descent.solve(blocks, b, [0.0, 10.0], route="streaming"), 7, "x")


@query
def bcd_one_pass(spark, folder):
    blocks, b = _order_blocks(spark, folder)
    models = BlockCoordinateDescent(QrTree()).solve_one_pass(iter(blocks), b, [0.0, 10.0])
    rows = [
        (p, lam, float(x[0, 0])) for p, model in enumerate(models) for lam, x in zip([0.0, 10.0], model)
    ]
    return rounded(spark.createDataFrame(rows, "col_block int, lam double, x double"), 7, "x")


@query
def residual_norms(spark, folder):
    system = line_system(spark, folder)
    return rounded(residual_norm(system, np.array([1.0, 0.5, -0.25])), 4)


@query
def residual_norm_of_fit(spark, folder):
    system = line_system(spark, folder)
    return rounded(residual_norm(system, solution_array(NormalEquations().solve(system), 3)), 4)


@query
def rel_error(spark, folder):
    system = line_system(spark, folder)
    both = NormalEquations().solve_many_l2(system, [0.0, 1000.0]).cache()
    return rounded(relative_error(both.filter("lam = 1000.0"), both.filter("lam = 0.0")), 8)


# -- generated data, keyed by the orders ---------------------------------------------------------------------


def _moments(matrix: RowMatrix) -> DataFrame:
    cells = matrix.base.select("row_id", F.explode("vec").alias("x"))
    return cells.agg(
        F.count("x").alias("n"),
        F.round(F.avg("x"), 1).alias("mean"),
        F.round(F.stddev_pop("x"), 1).alias("spread"),
        F.countDistinct("x").alias("different"),
    )


@query
def random_uniform(spark, folder):
    return _moments(uniform_for(table(spark, folder, "orders"), "o_orderkey", 8, seed=7))


@query
def random_normal(spark, folder):
    return _moments(normal_for(table(spark, folder, "orders"), "o_orderkey", 8, seed=7)).withColumn(
        "mean", neat("mean", 1)
    )


@query
def linear_system_checks(spark, folder):
    """Generated systems: size, true condition number, and the residual in units of sin(theta) ||A x||."""
    left = uniform_for(table(spark, folder, "orders"), "o_orderkey", 6, seed=11)
    systems = linear_systems(left, n_targets=2, conditions=[1.0, 10.0, 1000.0], thetas=[0.5])
    checks = None
    for one in systems.known:
        system = systems.system(one.system_id)
        expected = float(np.linalg.norm(np.sin(one.theta) * one.product_norms))
        optimum = residual_norm(system, one.x * np.cos(one.theta)).select((F.col("value") / expected).alias("ratio"))
        r = system.matrix()
        row = optimum.select(
            F.lit(one.condition).alias("condition"),
            F.lit(r.n_rows).cast("bigint").alias("n_rows"),
            neat("ratio", 6).alias("residual_ratio"),
            neat(F.lit(condition_numbers(r).head().cond_2 / one.condition**0.8), 6).alias("cond_ratio"),
        )
        checks = row if checks is None else checks.unionByName(row)
    return checks


@query
def accuracy_sweep(spark, folder):
    """Which route still finds the solution to four digits, for each condition number."""
    left = uniform_for(table(spark, folder, "orders"), "o_orderkey", 11, seed=3)
    report = accuracy_report(linear_systems(left))
    return report.select("solver", "condition", (F.col("relative_error") < 1e-4).alias("four_digits"))
