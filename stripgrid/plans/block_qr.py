"""R factor of a block matrix that may be wide: panels of columns, one after another.

For each panel: a tall QR of the panel gives its diagonal block and its Q; S = Q'A for the columns to the right is
the rest of the panel's rows of R; A -= Q S removes the panel's directions. The projection is applied twice, which
keeps the remaining columns orthogonal to the panel to rounding level.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..block_matrix import POSITION, BlockMatrix
from ..functions.arrow import keyed_rows
from ..functions.lineage import cut_lineage
from ..operators.folding import PARTIAL_SCHEMA, merge_tree
from .strip_qr import AddRows, NearlyDependent, fits_strips, strip_qr_r
from .tall_qr import ThinQR, divide_right, squares_of, thin_qr

_SUMS = "block_col int, s array<double>"


def block_qr_r(matrix: BlockMatrix, route: str = "auto") -> BlockMatrix:
    """R as a block matrix with the column panels of the input; diagonal >= 0.

    ``strips`` (``strip_qr``) deals the matrix to row strips once and never moves it again; it needs a row of blocks of R to
    fit a task. ``blocks`` joins panels with the columns to their right, for wider matrices and for panels whose
    columns are nearly dependent. ``auto`` starts with strips and turns to blocks where they don't do.
    """
    if route not in ("auto", "strips", "blocks"):
        raise ValueError("route must be auto, strips or blocks")
    panels = matrix.column_panels()
    n_rows, n_cols = matrix.dim
    if n_cols and n_rows and route != "blocks" and (route == "strips" or fits_strips(panels)):
        try:
            return BlockMatrix(strip_qr_r(matrix.df, panels, n_rows), (min(n_rows, n_cols), n_cols))
        except NearlyDependent:
            if route == "strips":
                raise ValueError("the columns of a panel are nearly dependent; use the route over blocks") from None
    return _over_blocks(matrix)


def _over_blocks(matrix: BlockMatrix) -> BlockMatrix:
    spark = matrix.df.sparkSession
    trailing = cut_lineage(matrix.df)
    n_rows, n_cols = BlockMatrix(trailing).dim
    panels = BlockMatrix(trailing).column_panels()
    pieces: list[DataFrame] = []
    for block_col, col_start, width in panels:
        if col_start >= n_rows:
            break
        height = min(width, n_rows - col_start)
        panel = BlockMatrix(trailing).col_block(block_col, width)
        factor = thin_qr(panel)
        pieces.append(_diagonal_piece(spark, block_col, col_start, width, height, factor.r))
        if block_col == panels[-1][0]:
            break
        rest = trailing.filter(F.col("block_col") > block_col)
        q_blocks = _q_blocks(factor, trailing.filter(F.col("block_col") == block_col))
        paired = rest.join(q_blocks, "block_row").persist(StorageLevel.MEMORY_AND_DISK)
        sums = cut_lineage(_cross(paired, factor.q.n_cols))
        once = _subtract(paired, sums, factor.q.n_cols).persist(StorageLevel.MEMORY_AND_DISK)
        more = cut_lineage(_cross(once, factor.q.n_cols))
        trailing = cut_lineage(_subtract(once, more, factor.q.n_cols).drop("q"))
        once.unpersist()
        paired.unpersist()
        pieces.append(_row_piece(sums, more, panels, block_col, col_start, factor.q.n_cols, height))
    result = pieces[0]
    for piece in pieces[1:]:
        result = result.unionByName(piece)
    return BlockMatrix(result, (min(n_rows, n_cols), n_cols))


def _diagonal_piece(spark, block_col: int, start: int, width: int, height: int, r: np.ndarray) -> DataFrame:
    row = (block_col, block_col, start, start, height, width, r[:height].ravel().tolist())
    schema = (
        "block_row int, block_col int, row_start bigint, col_start bigint, n_rows int, n_cols int, vals array<double>"
    )
    return spark.createDataFrame([row], schema)


def _q_blocks(factor: ThinQR, panel: DataFrame) -> DataFrame:
    """``(block_row, q)``: the panel's Q in the blocks of the panel."""
    factors = factor.factors
    if factors is None:
        return _regroup(factor.q.base.select("row_id", F.col("vec").alias("q")), panel)

    def apply(batches):
        for batch in batches:
            blocks = []
            for n_rows, vals in zip(batch.column("n_rows"), batch.column("vals")):
                blocks.append(divide_right(vals.values.to_numpy().reshape(n_rows.as_py(), -1), factors).ravel())
            yield pa.RecordBatch.from_arrays(
                [batch.column("block_row"), pa.array(blocks, pa.list_(pa.float64()))], ["block_row", "q"]
            )

    return panel.select("block_row", "n_rows", "vals").mapInArrow(apply, "block_row int, q array<double>")


def _regroup(q: DataFrame, panel: DataFrame) -> DataFrame:
    """Rows of Q back into the blocks of the panel. A group is one block."""
    positions = panel.select("block_row", F.posexplode(F.sequence("row_start", F.expr("row_start + n_rows - 1"))))
    placed = positions.select("block_row", F.col("col").alias("row_id")).join(q, "row_id")
    blocks = placed.groupBy("block_row").agg(F.sort_array(F.collect_list(F.struct("row_id", "q"))).alias("rows"))
    return blocks.select("block_row", F.flatten("rows.q").alias("q"))


def _cross(paired: DataFrame, rank: int) -> DataFrame:
    """S = sum over block rows of Q_i' A_ij, as ``(block_col, s)``. Tasks add up their own blocks first."""

    def partial(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block_col, q, a in _blocks_of(batch, rank):
                product = a.T @ q
                sums[block_col] = sums[block_col] + product if block_col in sums else product
        part = TaskContext.get().partitionId()
        for block_col, total in sums.items():
            yield from keyed_rows({"part": part, "key": block_col}, total)

    partials = paired.select("block_col", "n_rows", "n_cols", "q", "vals").mapInArrow(partial, PARTIAL_SCHEMA)

    def assemble(batches):
        for block_col, total in squares_of(batches, rank):
            yield pa.RecordBatch.from_arrays(
                [pa.array([block_col], pa.int32()), pa.array([total.ravel()], pa.list_(pa.float64()))],
                ["block_col", "s"],
            )

    return merge_tree(partials, AddRows(), rank * rank).coalesce(1).mapInArrow(assemble, _SUMS)


def _subtract(paired: DataFrame, sums: DataFrame, rank: int) -> DataFrame:
    """A_ij - Q_i S_j. Spark broadcasts the sums when it has measured them to be small, and shuffles otherwise."""
    joined = paired.join(sums, "block_col").select(*POSITION, "q", "s", "vals")

    def apply(batches):
        for batch in batches:
            changed = []
            for (_, q, a), s in zip(_blocks_of(batch, rank), batch.column("s")):
                changed.append((a - q @ s.values.to_numpy().reshape(-1, rank).T).ravel())
            keep = [batch.column(name) for name in [*POSITION, "q"]]
            yield pa.RecordBatch.from_arrays(
                [*keep, pa.array(changed, pa.list_(pa.float64()))], [*POSITION, "q", "vals"]
            )

    return joined.mapInArrow(apply, joined.select(*POSITION, "q", "vals").schema)


def _blocks_of(batch: pa.RecordBatch, rank: int):
    for block_col, n_rows, q, vals in zip(*[batch.column(name) for name in ("block_col", "n_rows", "q", "vals")]):
        rows = n_rows.as_py()
        yield block_col.as_py(), q.values.to_numpy().reshape(rows, rank), vals.values.to_numpy().reshape(rows, -1)


def _row_piece(
    first: DataFrame, second: DataFrame, panels: list[tuple], block_col: int, start: int, rank: int, height: int
) -> DataFrame:
    """Blocks of R to the right of the diagonal: both projections added up, turned from S' to S."""
    starts = F.create_map(*[F.lit(value) for c, col_start, _ in panels for value in (c, col_start)])
    total = F.zip_with("s", "s2", lambda x, y: x + y)
    both = (
        first.join(second.withColumnRenamed("s", "s2"), "block_col")
        .select("block_col", total.alias("s"))
        .withColumn("n_cols", F.expr(f"int(size(s) div {rank})"))
    )
    turned = F.flatten(
        F.transform(
            F.sequence(F.lit(0), F.lit(height - 1)),
            lambda r: F.transform(
                F.sequence(F.lit(0), F.col("n_cols") - 1), lambda c: F.element_at("s", c * rank + r + 1)
            ),
        )
    )
    return both.select(
        F.lit(block_col).alias("block_row"),
        "block_col",
        F.lit(start).cast("bigint").alias("row_start"),
        F.element_at(starts, F.col("block_col")).cast("bigint").alias("col_start"),
        F.lit(height).alias("n_rows"),
        "n_cols",
        turned.alias("vals"),
    )
