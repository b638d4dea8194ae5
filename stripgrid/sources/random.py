"""Random matrices keyed by position: the same cell has the same value on every recompute and partitioning."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..layout import Packed, quoted
from ..row_matrix import RowMatrix


def keyed_uniform(*keys: Column) -> Column:
    """Uniform in [0, 1) with 53 random bits, a function of the keys alone."""
    bits = F.shiftrightunsigned(F.xxhash64(*keys), 11)
    return bits.cast("double") * F.lit(2.0**-53)


# Fixed values of ``replayable_uniform``: a prime below 2^31, so that squares stay in a long, and multipliers below it.
PRIME = 2**31 - 1
MIX = (48271, 69621, 40692, 16807, 39373)


def replayable_uniform(key: Column, step: Column, seed: int) -> Column:
    """Uniform in [0, 1) from an integer key and a step, by integer arithmetic that any SQL engine can repeat.

    With k = key mod p + 40692 (key div p): a = 48271 k + 69621 step + seed, b = a^2 + 16807 a + step,
    c = b^2 + 39373 b + k, each modulo p = 2^31 - 1; the result is c / p.
    """
    k = _folded(key)
    return _third(_second(_first(k, step, seed), step), k)


def replayable_below(key: Column, steps: int, seed: int, limit: float) -> Column:
    """The steps 1 .. ``steps`` whose uniform for this key is below ``limit``, as an array.

    The stages are arrays of their own, because a lambda would work out each repeated term anew."""
    every, k = F.sequence(F.lit(1), F.lit(steps)), _folded(key)
    first = F.transform(every, lambda t: _first(k, t, seed))
    second = F.zip_with(first, every, _second)
    drawn = F.zip_with(second, every, lambda b, t: F.when(_third(b, k) < limit, t))
    return F.filter(drawn, lambda t: t.isNotNull())


def replayable_steps(frame: DataFrame, key: Column, steps: int, seed: int, limit: float, step: str) -> DataFrame:
    """A row for each step that ``replayable_below`` gives, with the step in a column: the same in compiled code."""
    rows = frame.withColumn("_k", _folded(key)).withColumn(step, F.explode(F.sequence(F.lit(1), F.lit(steps))))
    rows = rows.withColumn("_a", _first(F.col("_k"), F.col(step), seed)).withColumn("_b", _second(F.col("_a"), F.col(step)))
    return rows.where(_third(F.col("_b"), F.col("_k")) < limit).drop("_k", "_a", "_b")


def _folded(key: Column) -> Column:
    p = F.lit(PRIME).cast("bigint")
    key = key.cast("bigint")
    return F.pmod(F.pmod(key, p) + F.lit(MIX[2]) * F.pmod(F.call_function("div", key, p), p), p)


def _first(k: Column, step: Column, seed: int) -> Column:
    return F.pmod(F.lit(MIX[0]) * k + F.lit(MIX[1]) * step.cast("bigint") + F.lit(seed % PRIME), F.lit(PRIME).cast("bigint"))


def _second(a: Column, step: Column) -> Column:
    return F.pmod(a * a + F.lit(MIX[3]) * a + step.cast("bigint"), F.lit(PRIME).cast("bigint"))


def _third(b: Column, k: Column) -> Column:
    return F.pmod(b * b + F.lit(MIX[4]) * b + k, F.lit(PRIME).cast("bigint")) / F.lit(float(PRIME))


def uniform_cells(row: Column, n_cols: int, seed: int) -> Column:
    columns = F.sequence(F.lit(0), F.lit(n_cols - 1))
    return F.transform(columns, lambda j: keyed_uniform(row, j, F.lit(seed)))


def normal_cells(row: Column, n_cols: int, seed: int) -> Column:
    """Standard normals by Box-Muller on two keyed uniforms per cell."""

    def normal(j: Column) -> Column:
        radius = F.sqrt(-2.0 * F.log(1.0 - keyed_uniform(row, j, F.lit(seed), F.lit(0))))
        angle = 2.0 * math.pi * keyed_uniform(row, j, F.lit(seed), F.lit(1))
        return radius * F.cos(angle)

    return F.transform(F.sequence(F.lit(0), F.lit(n_cols - 1)), normal)


def uniform_for(keys: DataFrame, row_id: str, n_cols: int, seed: int = 0) -> RowMatrix:
    """A uniform [0, 1) row for every key of a table."""
    rows = keys.select(quoted(row_id).cast("bigint").alias("row_id"))
    vec = uniform_cells(F.col("row_id"), n_cols, seed)
    return RowMatrix(rows.select("row_id", vec.alias("vec")), Packed("vec", n_cols))


def normal_for(keys: DataFrame, row_id: str, n_cols: int, seed: int = 0) -> RowMatrix:
    """A standard normal row for every key of a table."""
    rows = keys.select(quoted(row_id).cast("bigint").alias("row_id"))
    vec = normal_cells(F.col("row_id"), n_cols, seed)
    return RowMatrix(rows.select("row_id", vec.alias("vec")), Packed("vec", n_cols))


def random_uniform(spark: SparkSession, n_rows: int, n_cols: int, seed: int = 0, partitions: int | None = None):
    """n_rows x n_cols matrix, uniform on [0, 1)."""
    drawn = uniform_for(spark.range(0, n_rows, 1, partitions), "id", n_cols, seed)
    return drawn.replace(drawn.base, drawn.cells, n_rows=n_rows)


def random_normal(spark: SparkSession, n_rows: int, n_cols: int, seed: int = 0, partitions: int | None = None):
    """n_rows x n_cols matrix of standard normals."""
    drawn = normal_for(spark.range(0, n_rows, 1, partitions), "id", n_cols, seed)
    return drawn.replace(drawn.base, drawn.cells, n_rows=n_rows)
