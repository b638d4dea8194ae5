"""Comparing matrices and laying several out alike."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..layout import Packed


def max_difference(a, b) -> DataFrame:
    """One row ``(max_abs_diff)`` over all cells; rows present on one side only are an error."""
    gaps = (a - b).base.select(F.array_max(F.transform("vec", F.abs)).alias("gap"))
    return gaps.agg(F.coalesce(F.max("gap"), F.lit(0.0)).alias("max_abs_diff"))


def about_equal(a, b, tolerance: float = 1e-8) -> DataFrame:
    """One row ``(max_abs_diff, close)``."""
    return max_difference(a, b).withColumn("close", F.col("max_abs_diff") < tolerance)


def co_partition(matrices: Sequence, partitions: int) -> list:
    """Hash the rows of several matrices alike on their key, so that later joins between them need no shuffle."""
    aligned = []
    for matrix in matrices:
        key = matrix.require_key()
        packed = matrix.base.select(key, matrix.cells.array().alias("vec"))
        aligned.append(matrix.replace(packed.repartition(partitions, key), Packed("vec", matrix.n_cols)))
    return aligned
