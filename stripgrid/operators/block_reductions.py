"""Reductions over a block grid: each block is reduced in place, then the short results are combined by key."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.monoids import Monoid, monoid
from ..layout import VECTOR, Packed, explode_cells
from .folding import ColumnReduce, fold_rows
from .reductions import reduce_values


def by_row(df: DataFrame, op) -> DataFrame:
    """Blocks of the n x 1 result; partials of one block row are combined element by element."""
    keys = ["block_row", "row_start", "n_rows"]
    if isinstance(op, str):
        reducer = monoid(op)
        partials = explode_cells(_local_ufunc(df, reducer.ufunc, axis=1), keys, F.col("part"), "pos", "x")
        combined = _combine(partials, keys, reducer)
    else:
        combined = _combine_ufunc(_local_ufunc(df, op, axis=1), keys, op)
    return combined.select(
        "block_row",
        F.lit(0).alias("block_col"),
        "row_start",
        F.lit(0).cast("bigint").alias("col_start"),
        "n_rows",
        F.lit(1).alias("n_cols"),
        "vals",
    )


def by_column(df: DataFrame, op) -> DataFrame:
    """Blocks of the 1 x m result. Named reducers are added up in each task before anything is shuffled."""
    if isinstance(op, str):
        keys = ["block_col", "col_start", "n_cols"]
        cells = explode_cells(df, keys, F.col("vals"), "at", "x")
        combined = _combine(cells.select(*keys, (F.col("at") % F.col("n_cols")).alias("pos"), "x"), keys, monoid(op))
    else:
        combined = _columns_ufunc(df, op)
    return combined.select(
        F.lit(0).alias("block_row"),
        "block_col",
        F.lit(0).cast("bigint").alias("row_start"),
        "col_start",
        F.lit(1).alias("n_rows"),
        "n_cols",
        "vals",
    )


def of_all(df: DataFrame, op) -> DataFrame:
    """One row ``(value)``."""
    if isinstance(op, str):
        return reduce_values(df, Packed("vals", 0), monoid(op))
    local = _local_ufunc(df, op, axis=None)
    reduced = fold_rows(local, [Packed("part", 1)], ColumnReduce(op))
    return reduced.select(F.col("vec")[0].alias("value"))


def _combine(partials: DataFrame, keys: list[str], reducer: Monoid) -> DataFrame:
    """Reduce ``x`` per position, then put the positions of one block back in order (one block's worth per list)."""
    totals = partials.groupBy(*keys, "pos").agg(reducer.aggregate(F.col("x")).alias("x"))
    lists = totals.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("pos", "x"))).alias("pairs"))
    return lists.select(*keys, F.col("pairs.x").alias("vals"))


def _local_ufunc(df: DataFrame, op: np.ufunc, axis: int | None) -> DataFrame:
    def reduce_blocks(batches):
        for batch in batches:
            parts = []
            for vals, n_rows, n_cols in zip(batch.column("vals"), batch.column("n_rows"), batch.column("n_cols")):
                block = vals.values.to_numpy().reshape(n_rows.as_py(), n_cols.as_py())
                parts.append(np.atleast_1d(op.reduce(block, axis=axis)))
            keep = batch.schema.names[:-1]
            lists = pa.array(parts, pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(name) for name in keep] + [lists], [*keep, "part"])

    source = df.select("block_row", "block_col", "row_start", "col_start", "n_rows", "n_cols", "vals")
    schema = source.drop("vals").schema.add("part", VECTOR)
    return source.mapInArrow(reduce_blocks, schema)


def _combine_ufunc(local: DataFrame, keys: list[str], op: np.ufunc) -> DataFrame:
    """One group holds the partials of one block row: as many as the grid has block columns."""

    def fold(group: tuple, table: pa.Table) -> pa.Table:
        parts = np.vstack([np.asarray(part) for part in table.column("part").to_pylist()])
        columns = {name: pa.array([value.as_py()], value.type) for name, value in zip(keys, group)}
        return pa.table({**columns, "vals": pa.array([op.reduce(parts, axis=0)], pa.list_(pa.float64()))})

    schema = local.select(*keys).schema.add("vals", VECTOR)
    return local.select(*keys, "part").groupBy(*keys).applyInArrow(fold, schema)


def _columns_ufunc(df: DataFrame, op: np.ufunc) -> DataFrame:
    """Partials of one block column come from every block row, so they are streamed through the merge tree.

    Blocks of a column share one width; narrower columns are padded for the fold and cut back afterwards.
    """
    panels = df.select("block_col", "col_start", "n_cols").distinct()
    widest = panels.agg(F.max("n_cols")).head()[0] or 0
    local = _local_ufunc(df, op, axis=0)
    padded = F.concat("part", F.array_repeat(F.lit(0.0), F.lit(widest) - F.col("n_cols")))
    reduced = fold_rows(
        local.select("block_col", padded.alias("part")), [Packed("part", widest)], ColumnReduce(op), key="block_col"
    )
    return panels.join(reduced.withColumnRenamed("key", "block_col"), "block_col").select(
        "block_col", "col_start", "n_cols", F.slice("vec", F.lit(1), F.col("n_cols")).alias("vals")
    )
