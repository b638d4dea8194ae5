"""Block matrices from row matrices and from ready-made blocks."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..block_matrix import POSITION, BlockMatrix, Steps
from ..functions.lineage import cut_lineage
from ..functions.prefix import running_start
from ..layout import explode_cells
from ..row_matrix import RowMatrix


def to_grid(matrix: RowMatrix, rows_per_block: int, cols_per_block: int) -> BlockMatrix:
    """Cut rows into blocks; the last block of each direction may be smaller.

    One shuffle on the block position. A group is one block, so its size is bounded by the block shape, and its
    rows are put in order of ``row_id``.
    """
    key, r, c = matrix.require_key(), int(rows_per_block), int(cols_per_block)
    panels = -(-matrix.n_cols // c)
    pieces = F.transform(
        F.sequence(F.lit(0), F.lit(panels - 1)), lambda p: F.slice(matrix.cells.array(), p * c + 1, F.lit(c))
    )
    position = [_block_of(key, r), F.col(key).alias("row_id")]
    cut = explode_cells(matrix.base, position, pieces, "block_col", "piece")
    blocks = cut.groupBy("block_row", "block_col").agg(
        F.sort_array(F.collect_list(F.struct("row_id", "piece"))).alias("rows")
    )
    return BlockMatrix(
        blocks.select(
            "block_row",
            "block_col",
            (F.col("block_row").cast("bigint") * r).alias("row_start"),
            (F.col("block_col").cast("bigint") * c).alias("col_start"),
            F.size("rows").alias("n_rows"),
            F.size(F.col("rows")[0]["piece"]).alias("n_cols"),
            F.flatten("rows.piece").alias("vals"),
        ),
        # Counting the rows of the source is cheaper than building the blocks to measure them.
        dim=lambda: (matrix.n_rows, matrix.n_cols),
        steps=(Steps(r, r), Steps(c, c)),
    )


def from_blocks(blocks: DataFrame) -> BlockMatrix:
    """Blocks ``(block_row, block_col, n_rows, n_cols, vals)`` of any heights and widths, stacked in id order.

    Ids are renumbered densely and start positions are running sums over the block directory (one entry per block
    row or block column). Both directories come from one scan of the positions, which is written down before the running
    sums use it; the values are read once, when the matrix is used.
    """
    sizes = blocks.groupingSets(
        [["block_row"], ["block_col"]], "block_row", "block_col"
    ).agg(
        F.grouping("block_row").alias("across"),
        F.max("n_rows").alias("most_rows"),
        F.min("n_rows").alias("least_rows"),
        F.max("n_cols").alias("most_cols"),
        F.min("n_cols").alias("least_cols"),
    )
    sizes = cut_lineage(sizes)
    rows = _directory(sizes.where("across = 0"), "block_row", "rows", "new_row", "row_start")
    cols = _directory(sizes.where("across = 1"), "block_col", "cols", "new_col", "col_start")
    placed = blocks.join(rows, "block_row").join(cols, "block_col")
    return BlockMatrix(
        placed.select(
            F.col("new_row").cast("int").alias("block_row"),
            F.col("new_col").cast("int").alias("block_col"),
            "row_start",
            "col_start",
            F.col("n_rows").cast("int").alias("n_rows"),
            F.col("n_cols").cast("int").alias("n_cols"),
            "vals",
        )
    )


def _directory(sizes: DataFrame, block: str, size: str, dense: str, start: str) -> DataFrame:
    most, least = F.col(f"most_{size}"), F.col(f"least_{size}")
    checked = F.when(most == least, most).otherwise(
        F.raise_error(F.lit(f"blocks with the same {block} must have the same n_{size}")).cast("int")
    )
    sizes = sizes.select(block, checked.alias("size"), F.lit(1).alias("one"))
    placed = running_start(running_start(sizes, block, "size", start), block, "one", dense)
    return placed.select(block, dense, start)


def _block_of(key: str, rows_per_block: int):
    """Block row of a key; more block rows than an INT holds are an error of the cast, not a wrapped number."""
    return (F.expr(f"`{key}` div {rows_per_block}")).cast("int").alias("block_row")


def blocks_of_local(spark: SparkSession, local: np.ndarray, size: int = 512) -> BlockMatrix:
    """A NumPy matrix as a grid of ``size`` x ``size`` blocks."""
    rows, cols = local.shape
    data = [
        (i // size, j // size, i, j, min(size, rows - i), min(size, cols - j), local[i : i + size, j : j + size].ravel())
        for i in range(0, rows, size)
        for j in range(0, cols, size)
    ]
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.float64())]
    table = pa.table([pa.array([row[c] for row in data], kind) for c, kind in enumerate(kinds)], names=[*POSITION, "vals"])
    return BlockMatrix(spark.createDataFrame(table), (rows, cols), (Steps(size, size), Steps(size, size)))


def stack_columns(parts: Sequence[RowMatrix], rows_per_block: int) -> BlockMatrix:
    """Column blocks of one matrix, side by side in the order given, as a grid with one block column per part.

    All parts are brought together in one shuffle, however many there are; their rows may come in any order and
    partitioning. Every part must have the same row keys, each once; else reading the values raises an error.
    """
    if not parts:
        raise ValueError("no column blocks given")
    stacked = None
    for p, part in enumerate(parts):
        rows = part.base.select(
            F.lit(p).alias("block_col"), F.col(part.require_key()).alias("row_id"), part.cells.array().alias("vec")
        )
        stacked = rows if stacked is None else stacked.unionByName(rows)
    return _grid_of_parts(stacked, [part.n_cols for part in parts], rows_per_block, lambda: parts[0].n_rows)


def from_column_parts(
    df: DataFrame, part: str, row_id: str, column: str, rows_per_block: int, parts: Sequence[int] | None = None
) -> BlockMatrix:
    """The same from one table that is partitioned by columns: rows ``(part, row_id, array)``.

    Parts are put side by side in the order of their ids. A first pass reads the ids and widths (one entry per part);
    ``parts`` names the ids that must be there, for blocks that arrive one after another: it is an error if one is
    missing or if another one is there.
    """
    sizes = df.groupBy(F.col(part).alias("part")).agg(
        F.min(F.size(column)).alias("least"), F.max(F.size(column)).alias("most"), F.count("*").alias("n")
    )
    found = sizes.orderBy("part").collect()
    if parts is not None and sorted(parts) != [row.part for row in found]:
        raise ValueError(f"column parts {[row.part for row in found]} are there, {sorted(parts)} are wanted")
    if any(row.least != row.most for row in found):
        raise ValueError(f"rows of one column part differ in length: {[r.part for r in found if r.least != r.most]}")
    if len({row.n for row in found}) > 1:
        raise ValueError("column parts have different numbers of rows")
    numbered = df.sparkSession.createDataFrame([(row.part, i) for i, row in enumerate(found)], "part bigint, block_col int")
    rows = df.select(
        F.col(part).cast("bigint").alias("part"),
        F.col(row_id).cast("bigint").alias("row_id"),
        F.col(column).cast("array<double>").alias("vec"),
    )
    stacked = rows.join(numbered, "part").select("block_col", "row_id", "vec")
    return _grid_of_parts(stacked, [row.most for row in found], rows_per_block, lambda: found[0].n if found else 0)


def _grid_of_parts(rows: DataFrame, widths: list[int], rows_per_block: int, n_rows) -> BlockMatrix:
    """Blocks from ``(block_col, row_id, vec)``: dealt by block row, so that one exchange serves both the blocks and the
    comparison of the parts' keys. A group is one block, and a window one block row."""
    r, starts = int(rows_per_block), [sum(widths[:p]) for p in range(len(widths))]
    dealt = rows.select(_block_of("row_id", r), "block_col", "row_id", "vec").repartition("block_row")
    blocks = dealt.groupBy("block_row", "block_col").agg(
        F.sort_array(F.collect_list(F.struct("row_id", "vec"))).alias("rows")
    )
    keys = F.col("rows.row_id")
    together = Window.partitionBy("block_row")
    blocks = blocks.withColumn("mark", F.xxhash64(keys)).withColumns(
        {
            "parts": F.count("*").over(together),
            "same": F.min("mark").over(together) == F.max("mark").over(together),
            "once": F.size(F.array_distinct(keys)) == F.size(keys),
        }
    )
    complete = (F.col("parts") == len(widths)) & F.col("same") & F.col("once")
    vals = F.when(complete, F.flatten("rows.vec")).otherwise(
        F.raise_error(F.lit("column blocks must have the same rows, each once")).cast("array<double>")
    )
    places = F.array(*[F.struct(F.lit(s).cast("bigint").alias("start"), F.lit(w).alias("width")) for s, w in zip(starts, widths)])
    place = F.element_at(places, F.col("block_col") + 1)
    equal = Steps(widths[0], widths[0]) if widths and all(w == widths[0] for w in widths[:-1]) and widths[-1] <= widths[0] else None
    return BlockMatrix(
        blocks.select(
            "block_row",
            "block_col",
            (F.col("block_row").cast("bigint") * r).alias("row_start"),
            place["start"].alias("col_start"),
            F.size("rows").alias("n_rows"),
            place["width"].cast("int").alias("n_cols"),
            vals.alias("vals"),
        ),
        dim=lambda: (n_rows(), sum(widths)),
        steps=(Steps(r, r), equal),
    )
