"""Reductions of elements, rows and columns of a row matrix. Reducers must be associative and commutative.

A reducer is one of ``sum``, ``prod``, ``min``, ``max`` (planned by Catalyst, with map-side partials) or a NumPy
ufunc (streamed through Arrow, one partial per task).
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions.arrow import matrix_of
from ..functions.monoids import Monoid, monoid
from ..layout import NARROW, Cells, Packed, Wide, explode_cells
from .folding import ColumnReduce, fold_rows

# Up to this many array elements are read one by one in compiled code.
UNROLLED = 16
# User-defined states are small, so many of them meet in one node of the merge tree.
STATES_PER_NODE = 1024


def row_values(matrix, op) -> DataFrame:
    """``(row_id, value)``: each row reduced in place, without a shuffle."""
    key, cells = matrix.require_key(), matrix.cells
    if not isinstance(op, str):
        return _row_values_ufunc(matrix, op)
    reducer = monoid(op)
    if isinstance(cells, Wide) or 0 < cells.width <= UNROLLED:
        value = reducer.of_items(cells.items())
    elif reducer.of_array is not None:
        value = reducer.of_array(cells.array())
    else:
        # Lambdas over arrays are interpreted element by element; Arrow batches take half the time.
        return _row_values_ufunc(matrix, reducer.ufunc)
    return matrix.base.select(key, value.alias("value"))


def _row_values_ufunc(matrix, op: np.ufunc) -> DataFrame:
    key, cells = matrix.require_key(), matrix.cells

    def reduce_rows(batches):
        for batch in batches:
            values = op.reduce(matrix_of(batch, [cells]), axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(values, pa.float64())], [key, "value"])

    return matrix.base.select(key, *cells.columns()).mapInArrow(reduce_rows, f"{key} bigint, value double")


def col_values(matrix, op) -> DataFrame:
    """``(j, value)``: each column reduced."""
    cells = matrix.cells
    if not isinstance(op, str):
        reduced = fold_rows(matrix.base, [cells], ColumnReduce(op))
        return reduced.select(F.posexplode("vec").alias("j", "value"))
    reducer = monoid(op)
    if cells.width <= NARROW:
        totals = matrix.base.agg(*[reducer.aggregate(x).alias(f"c{j}") for j, x in enumerate(cells.items())])
        vec = F.array(*[F.col(f"c{j}") for j in range(cells.width)])
        return totals.select(F.posexplode(vec).alias("j", "value")).filter("value is not null")
    exploded = explode_cells(matrix.base, [], cells.array(), "j", "x")
    return exploded.groupBy("j").agg(reducer.aggregate(F.col("x")).alias("value"))


def all_values(matrix, op) -> DataFrame:
    """One row ``(value)``: every element reduced; NULL for an empty matrix."""
    if not isinstance(op, str):
        by_column = fold_rows(matrix.base, [matrix.cells], ColumnReduce(op))

        def finish(batches):
            for batch in batches:
                flat = batch.column("vec").flatten().to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array([op.reduce(flat)], pa.float64())], ["value"])

        return by_column.mapInArrow(finish, "value double")
    return reduce_values(matrix.base, matrix.cells, monoid(op))


def reduce_values(frame: DataFrame, cells: Cells, reducer: Monoid) -> DataFrame:
    """One row ``(value)`` over all cells, in compiled code: explode + aggregate beats a lambda over each array."""
    if isinstance(cells, Wide):
        return frame.agg(reducer.aggregate(reducer.of_items(cells.items())).alias("value"))
    if reducer.of_array is not None:
        return frame.agg(reducer.aggregate(reducer.of_array(cells.array())).alias("value"))
    return explode_cells(frame, [], cells.array(), "pos", "x").agg(reducer.aggregate(F.col("x")).alias("value"))


def norm_frobenius(matrix) -> DataFrame:
    """One row ``(value)``: square root of the sum of squares."""
    return root_of_squares(matrix.base, matrix.cells)


def root_of_squares(frame: DataFrame, cells: Cells) -> DataFrame:
    if isinstance(cells, Wide):
        squares = monoid("sum").of_items([x * x for x in cells.items()])
    else:
        frame = explode_cells(frame, [], cells.array(), "pos", "x")
        squares = F.col("x") * F.col("x")
    return frame.agg(F.sqrt(F.coalesce(F.sum(squares), F.lit(0.0))).alias("value"))


def fold_elements(
    matrix,
    zero: tuple,
    seq_op: Callable[[tuple, np.ndarray], tuple],
    comb_op: Callable[[tuple, tuple], tuple],
    schema: str,
) -> DataFrame:
    """Fold of all elements into a user-defined state, one row of ``schema`` (primitive fields).

    ``seq_op(state, values)`` takes a block of elements at a time, ``comb_op`` merges two states, and ``zero`` must
    be neutral for ``comb_op`` because each task starts from it.
    """
    cells, spark = matrix.cells, matrix.base.sparkSession
    fields = to_arrow_schema(StructType.fromDDL(schema))
    names = fields.names

    keyed = fields.append(pa.field("_node", pa.int32()))

    def emit(state, node):
        values = {name: [value] for name, value in zip([*names, "_node"], [*state, node])}
        return pa.RecordBatch.from_pydict(values, schema=keyed)

    def partial(batches):
        state = zero
        for batch in batches:
            if batch.num_rows:
                state = seq_op(state, matrix_of(batch, [cells]).ravel())
        yield emit(state, TaskContext.get().partitionId() // STATES_PER_NODE)

    def merge(batches):
        """States arrive sorted by node; a task holds one merged state."""
        node, state = None, zero
        for batch in batches:
            for row in batch.to_pylist():
                if row["_node"] != node:
                    if node is not None:
                        yield emit(state, node)
                    node, state = row["_node"], zero
                state = comb_op(state, tuple(row[name] for name in names))
        yield emit(state, node or 0)

    schema = f"{schema}, _node int"
    states = matrix.base.select(*cells.columns()).mapInArrow(partial, schema)
    nodes = states.repartition("_node").sortWithinPartitions("_node").mapInArrow(merge, schema)
    whole = nodes.withColumn("_node", F.lit(0)).repartition(1).mapInArrow(merge, schema)
    return whole.drop("_node")


def as_row_matrix(matrix, values: DataFrame):
    """``(j, value)`` as a 1 x n matrix. One list of n numbers: bounded by the number of columns."""
    row = values.agg(F.sort_array(F.collect_list(F.struct("j", "value"))).alias("pairs"))
    vec = row.select(F.lit(0).cast("bigint").alias("row_id"), F.col("pairs.value").alias("vec"))
    return matrix.replace(vec, Packed("vec", matrix.cells.width), n_rows=1, key="row_id")
