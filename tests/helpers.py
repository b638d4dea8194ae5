"""Matrices from NumPy arrays, spread over several partitions in shuffled order."""

import numpy as np
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException

from stripgrid.sources.grids import to_grid
from stripgrid.sources.tables import from_arrays, from_columns

# An error raised inside a query; Spark wraps it when two stages fail at once.
RUN_ERRORS = (PySparkException, Py4JJavaError)

M1 = np.array([[1, 2, 3], [1, 9, -1], [0, 0, 1], [0, 1, 0]], dtype=float)
M2 = np.array([[1, 2, 3], [1, 9, -1], [1, 0, 1], [1618, 1, 4]], dtype=float)
M3 = np.array([[1, 2, 1], [1, 9, -1], [1, 0, 1], [7, 1, 1618]], dtype=float)
M4 = np.array([[1, 2, 3], [1, 9, -1], [0, 1618, 1], [0, 1, 0]], dtype=float)


def rows_of(spark, array, partitions=4):
    data = [(i, [float(x) for x in row]) for i, row in enumerate(array)]
    frame = spark.createDataFrame(data, "row_id bigint, v array<double>").repartition(partitions)
    return from_arrays(frame, "v", "row_id", n_cols=array.shape[1], n_rows=len(array))


def wide_of(spark, array, partitions=4):
    names = [f"v{j}" for j in range(array.shape[1])]
    schema = "row_id bigint, " + ", ".join(f"{name} double" for name in names)
    data = [(i, *[float(x) for x in row]) for i, row in enumerate(array)]
    return from_columns(spark.createDataFrame(data, schema).repartition(partitions), names, "row_id")


def grid_of(spark, array, rows, cols):
    return to_grid(rows_of(spark, array), rows, cols)


def positive(r):
    return r * np.where(np.diagonal(r) < 0, -1.0, 1.0)[:, None]


def ridge(a, b, lam):
    return np.linalg.solve(a.T @ a + lam * np.eye(a.shape[1]), a.T @ b)


def long_to_array(frame, shape):
    result = np.zeros(shape)
    for row in frame.collect():
        result[row.i, row.j] = row.value
    return result


def solutions(frame):
    """{(lam, j, rhs): x}."""
    return {(row.lam, row.j, row.rhs): row.x for row in frame.collect()}
