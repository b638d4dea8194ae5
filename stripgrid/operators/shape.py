"""Dimensions, strip directories and per-strip functions."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrow import matrix_of
from ..functions.prefix import running_start

STRIP_SCHEMA = "strip_id bigint, n_rows int, n_cols int, vals array<double>"


def dims(matrix) -> DataFrame:
    """One row ``(n_rows, n_cols)``. Only the row count is read; the width is known from the layout."""
    return matrix.base.agg(F.count(F.lit(1)).alias("n_rows")).select("n_rows", F.lit(matrix.n_cols).alias("n_cols"))


def strip_of(matrix, rows_per_strip: int):
    return F.expr(f"{matrix.require_key()} div {int(rows_per_strip)}")


def strip_directory(matrix, rows_per_strip: int) -> DataFrame:
    """``(strip_id, n_rows, start_row)``, one row per strip of ``rows_per_strip`` consecutive keys."""
    sizes = matrix.base.groupBy(strip_of(matrix, rows_per_strip).alias("strip_id")).agg(
        F.count(F.lit(1)).alias("n_rows")
    )
    return running_start(sizes, "strip_id", "n_rows", "start_row").select("strip_id", "n_rows", "start_row")


def map_strips_in_place(matrix, fn: Callable[[np.ndarray], np.ndarray], rows_per_strip: int, out_cols: int):
    """Apply ``fn`` to each strip; it must keep the number of rows. A group holds one strip, so its size is bounded."""
    key, cells = matrix.require_key(), matrix.cells

    def apply(table: pa.Table) -> pa.Table:
        keys, rows = _sorted_strip(table, key, cells)
        result = np.asarray(fn(rows), dtype=np.float64)
        if len(result) != len(rows):
            raise ValueError("the function changed the number of rows; use keep_rows=False")
        return pa.table({key: pa.array(keys), "vec": pa.array(list(result), pa.list_(pa.float64()))})

    grouped = matrix.base.select(key, strip_of(matrix, rows_per_strip).alias("strip_id"), *cells.columns())
    return grouped.groupBy("strip_id").applyInArrow(apply, f"{key} bigint, vec array<double>")


def map_strips_to_strips(matrix, fn: Callable[[np.ndarray], np.ndarray], rows_per_strip: int) -> DataFrame:
    """Apply ``fn`` to each strip; it may change both dimensions. Returns one row per resulting strip."""
    key, cells = matrix.require_key(), matrix.cells

    def apply(group: tuple, table: pa.Table) -> pa.Table:
        _, rows = _sorted_strip(table, key, cells)
        result = np.atleast_2d(np.asarray(fn(rows), dtype=np.float64))
        return pa.table(
            {
                "strip_id": pa.array([group[0].as_py()], pa.int64()),
                "n_rows": pa.array([result.shape[0]], pa.int32()),
                "n_cols": pa.array([result.shape[1]], pa.int32()),
                "vals": pa.array([result.ravel()], pa.list_(pa.float64())),
            }
        )

    grouped = matrix.base.select(key, strip_of(matrix, rows_per_strip).alias("strip_id"), *cells.columns())
    return grouped.groupBy("strip_id").applyInArrow(apply, STRIP_SCHEMA)


def _sorted_strip(table: pa.Table, key: str, cells) -> tuple[np.ndarray, np.ndarray]:
    batch = table.combine_chunks().to_batches()[0]
    keys = batch.column(key).to_numpy()
    order = np.argsort(keys, kind="stable")
    return keys[order], matrix_of(batch, [cells])[order]
