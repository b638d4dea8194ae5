"""Gram and cross products, and a distributed matrix times a small local matrix."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrow import matrix_of, matrix_to_lists
from ..layout import LOCAL_WIDTH, VECTOR, Cells
from .block_products import gram_blocks, gram_cells
from .folding import Gram, check_width, fold_rows

# Up to this many columns one hash aggregate with all the sums beats shipping rows to Python workers.
GENERATED_GRAM = 8
GENERATED_PRODUCT = 256
# Numbers of a local matrix that may travel with every task (128 MiB).
LOCAL_CELLS = 2**24


def gram_rows(frame: DataFrame, parts: list[Cells], key: str | None = None) -> DataFrame:
    """Gram matrix of the side-by-side parts as ``(key, i, vec)``, full square, each result in one partition."""
    width = sum(part.width for part in parts)
    check_width(width, "a Gram matrix")
    if width > GENERATED_GRAM:
        return fold_rows(frame, parts, Gram(width), key)
    items = [item for part in parts for item in part.items()]
    sums = [F.sum(items[i] * items[j]).alias(f"g{i}_{j}") for i in range(width) for j in range(i, width)]
    grouped = frame.groupBy(F.col(key).cast("int").alias("key")) if key else frame.groupBy()
    totals = grouped.agg(*sums, F.count(F.lit(1)).alias("n_rows")).filter("n_rows > 0")
    rows = [
        F.struct(
            F.lit(i).alias("i"), F.array(*[F.col(f"g{min(i, j)}_{max(i, j)}") for j in range(width)]).alias("vec")
        )
        for i in range(width)
    ]
    return totals.select(F.col("key") if key else F.lit(0).alias("key"), F.inline(F.array(*rows)))


def gram_long(frame: DataFrame, parts: list[Cells]) -> DataFrame:
    """Gram matrix as ``(i, j, value)``. Beyond ``LOCAL_WIDTH`` columns it is summed in tiles instead of in one task."""
    if sum(part.width for part in parts) > LOCAL_WIDTH:
        return gram_cells(gram_blocks(frame, parts))
    return gram_rows(frame, parts).select("i", F.posexplode("vec").alias("j", "value"))


def product_items(cells: Cells, local: np.ndarray) -> list[Column]:
    """Row times local matrix, one column expression per result column."""
    items = cells.items()
    columns = []
    for j in range(local.shape[1]):
        total = F.lit(0.0)
        for item, factor in zip(items, local[:, j]):
            total = total + item * F.lit(float(factor))
        columns.append(total)
    return columns


def times_local(frame: DataFrame, cells: Cells, local: np.ndarray, keep: list[str], out: str) -> DataFrame:
    """``keep`` columns plus ``out`` = row times ``local``. ``local`` is n x k and travels with the task."""
    local = np.asarray(local, dtype=np.float64)
    if local.ndim != 2 or local.shape[0] != cells.width:
        raise ValueError(f"cannot multiply {cells.width} columns by a local matrix of shape {local.shape}")
    if local.size > LOCAL_CELLS:
        raise ValueError(f"a local matrix of {local.shape} is too large to travel with tasks; multiply by a block matrix")
    if local.size <= GENERATED_PRODUCT:
        return frame.select(*keep, F.array(*product_items(cells, local)).cast(VECTOR).alias(out))
    source = frame.select(*keep, *cells.columns())
    kept = frame.select(*keep).schema

    def multiply(batches):
        for batch in batches:
            product = matrix_to_lists(matrix_of(batch, [cells]) @ local)
            yield pa.RecordBatch.from_arrays([batch.column(name) for name in keep] + [product], keep + [out])

    return source.mapInArrow(multiply, kept.add(out, VECTOR))
