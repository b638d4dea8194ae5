"""Parquet layouts for matrices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..block_matrix import POSITION, BlockMatrix, Steps
from ..row_matrix import RowMatrix
from .tables import from_arrays

_SHAPE = "n_rows bigint, n_cols bigint, row_lead bigint, row_size bigint, col_lead bigint, col_size bigint"
_BLOCK_TYPES = {"block_row": "int", "row_start": "bigint", "col_start": "bigint", "n_rows": "int", "n_cols": "int"}


def write_rows(matrix: RowMatrix, path: str) -> None:
    """Rows sorted by key inside each file, so that a row range skips row groups by their min/max."""
    matrix.df.sortWithinPartitions(matrix.require_key()).write.mode("errorifexists").parquet(path)


def read_rows(spark: SparkSession, path: str, n_cols: int | None = None) -> RowMatrix:
    return from_arrays(spark.read.parquet(path), "vec", "row_id", n_cols)


def write_blocks(matrix: BlockMatrix, path: str) -> None:
    """Blocks in ``path/blocks``, the size and the block boundaries beside them in ``path/shape``.

    One folder per block column, block rows in order inside it: column ranges prune folders, row ranges prune
    row groups. Range partitioning splits a long block column over many files. The shape is written last, so a
    folder without it holds no complete matrix.
    """
    spark = matrix.df.sparkSession
    ordered = matrix.df.repartitionByRange("block_col", "block_row").sortWithinPartitions("block_col", "block_row")
    ordered.write.mode("errorifexists").partitionBy("block_col").parquet(f"{path}/blocks")
    # Positions of the stored blocks are cheaper to read than those of the plan that made them.
    n_rows, n_cols = BlockMatrix(_read(spark, path)).dim
    edges = [x for steps in matrix.steps for x in ((steps.lead, steps.size) if steps else (None, None))]
    spark.createDataFrame([(n_rows, n_cols, *edges)], _SHAPE).coalesce(1).write.parquet(f"{path}/shape")


def read_blocks(spark: SparkSession, path: str) -> BlockMatrix:
    """The stored matrix. Its size is known without a pass, and where its boundaries are regular, element slices become
    bounds on ``block_col`` (folders) and ``block_row`` (row groups)."""
    shape = spark.read.schema(_SHAPE).parquet(f"{path}/shape").head()
    rows = Steps(shape.row_lead, shape.row_size) if shape.row_size is not None else None
    cols = Steps(shape.col_lead, shape.col_size) if shape.col_size is not None else None
    return BlockMatrix(_read(spark, path), (shape.n_rows, shape.n_cols), (rows, cols))


def _read(spark: SparkSession, path: str) -> DataFrame:
    schema = ", ".join(f"{name} {kind}" for name, kind in _BLOCK_TYPES.items())
    frame = spark.read.schema(f"{schema}, vals array<double>, block_col int").parquet(f"{path}/blocks")
    return frame.select(*[F.col(name) for name in POSITION], "vals")
