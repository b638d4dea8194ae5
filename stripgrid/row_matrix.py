"""A dense matrix stored by rows: one table row per matrix row, with an explicit position ``row_id``."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions.monoids import monoid
from .layout import VECTOR, Cells, Packed, Wide, explode_cells
from .operators import block_products, products, reductions, shape

INT_MAX = 2**31 - 1
KEEP = object()


class RowMatrix:
    """Handle over one DataFrame. Operators return new handles and stay lazy; scalars are actions.

    ``base`` holds the key (``row_id`` BIGINT, or none for tables without a row identity) and the cells, as one
    column per matrix column (``Wide``) or one array column (``Packed``).
    """

    def __init__(self, base: DataFrame, cells: Cells, key: str | None = "row_id", n_rows: int | None = None):
        self.base = base
        self.cells = cells
        self.key = key
        self._n_rows = n_rows

    def replace(self, base: DataFrame, cells: Cells, n_rows=KEEP, key=KEEP) -> RowMatrix:
        return RowMatrix(
            base, cells, self.key if key is KEEP else key, self._n_rows if n_rows is KEEP else n_rows
        )

    def require_key(self) -> str:
        if self.key is None:
            raise ValueError("this operator needs a row identity; build the matrix with row_id=...")
        return self.key

    def _key_columns(self) -> list[str]:
        return [self.key] if self.key else []

    @property
    def df(self) -> DataFrame:
        """Canonical frame ``(row_id, vec)``."""
        return self.base.select(*self._key_columns(), self.cells.array().alias("vec"))

    # -- shape -------------------------------------------------------------------------------------------

    @property
    def n_cols(self) -> int:
        return self.cells.width

    @property
    def n_rows(self) -> int:
        if self._n_rows is None:
            self._n_rows = self.base.count()
        return self._n_rows

    @property
    def dim(self) -> tuple[int, int]:
        return self.n_rows, self.n_cols

    def length(self) -> int:
        return self.n_rows * self.n_cols

    def strip_directory(self, rows_per_strip: int) -> DataFrame:
        return shape.strip_directory(self, rows_per_strip)

    # -- element-wise ------------------------------------------------------------------------------------

    def map_elements(self, fn: Callable[[Column], Column]) -> RowMatrix:
        """``fn`` maps a Column to a Column, so the work stays in Catalyst. A NULL result is an error; use NaN."""

        def mapped_value(x: Column) -> Column:
            return F.coalesce(fn(x).cast("double"), F.raise_error(F.lit("an element map gave NULL")).cast("double"))

        if isinstance(self.cells, Wide):
            mapped = [mapped_value(x).alias(name) for name, x in zip(self.cells.names, self.cells.items())]
            return self.replace(self.base.select(*self._key_columns(), *mapped), self.cells)
        vec = F.transform(self.cells.array(), mapped_value).alias(self.cells.name)
        return self.replace(self.base.select(*self._key_columns(), vec), self.cells)

    def map_numpy(self, fn: Callable[[np.ndarray], np.ndarray]) -> RowMatrix:
        """Element map by a NumPy function, for what column functions cannot express. Runs on Arrow batches."""
        import pyarrow as pa

        from .functions.arrow import matrix_of, matrix_to_lists

        keys, cells = self._key_columns(), self.cells

        def apply(batches):
            for batch in batches:
                vec = matrix_to_lists(np.asarray(fn(matrix_of(batch, [cells])), dtype=np.float64))
                yield pa.RecordBatch.from_arrays([batch.column(k) for k in keys] + [vec], keys + ["vec"])

        schema = self.base.select(*keys).schema.add("vec", VECTOR)
        mapped = self.base.select(*keys, *cells.columns()).mapInArrow(apply, schema)
        return self.replace(mapped, Packed("vec", cells.width))

    def map_strips(
        self,
        fn: Callable[[np.ndarray], np.ndarray],
        rows_per_strip: int,
        out_cols: int | None = None,
        keep_rows: bool = True,
    ) -> RowMatrix:
        """Apply ``fn`` to strips of ``rows_per_strip`` consecutive rows.

        With ``keep_rows`` row positions stay as they are; without it the results are stacked in strip order.
        """
        out_cols = self.n_cols if out_cols is None else out_cols
        if keep_rows:
            mapped = shape.map_strips_in_place(self, fn, rows_per_strip, out_cols)
            return self.replace(mapped, Packed("vec", out_cols))
        from .functions.lineage import cut_lineage
        from .sources.tables import from_strips

        # Written down, because both the start rows and the values need the strips: ``fn`` runs once for each.
        return from_strips(cut_lineage(shape.map_strips_to_strips(self, fn, rows_per_strip)), n_cols=out_cols)

    def pow(self, exponent: float) -> RowMatrix:
        return self.map_elements(lambda x: F.pow(x, F.lit(float(exponent))))

    def __add__(self, other) -> RowMatrix:
        if isinstance(other, (int, float)):
            return self.map_elements(lambda x: x + F.lit(float(other)))
        return self._zip(other, lambda x, y: x + y)

    def __sub__(self, other) -> RowMatrix:
        if isinstance(other, (int, float)):
            return self + (-float(other))
        return self._zip(other, lambda x, y: x - y)

    def __mul__(self, other: float) -> RowMatrix:
        return self.map_elements(lambda x: x * F.lit(float(other)))

    def __truediv__(self, other: float) -> RowMatrix:
        """Multiply by the IEEE reciprocal, so dividing by zero gives infinities rather than an ANSI error."""
        return self * reciprocal(other)

    def _zip(self, other, fn: Callable[[Column, Column], Column]) -> RowMatrix:
        """Rows matched on the key, in one shuffle that counts the rows of each key on both sides. A row that is missing
        on one side, or a key that is there twice, is an error, found while the plan runs."""
        if not isinstance(other, RowMatrix):
            raise TypeError("cannot combine matrices of different types")
        known = self._n_rows is not None and other._n_rows is not None
        if self.n_cols != other.n_cols or (known and self._n_rows != other._n_rows):
            raise ValueError("cannot combine matrices of unequal size")
        pairs = paired_rows([self, other], ["left", "right"], "cannot combine matrices of unequal size")
        joined = pairs.select("row_id", F.zip_with("left", "right", fn).alias("vec"))
        return self.replace(joined, Packed("vec", self.n_cols), key="row_id")

    # -- selection ---------------------------------------------------------------------------------------

    def __getitem__(self, ranges) -> RowMatrix:
        """``m[a:b, c:d]`` with half-open ranges; an open slice keeps everything on that side."""
        rows, cols = ranges
        return self._columns(cols)._rows(rows)

    def _rows(self, rows: slice) -> RowMatrix:
        if rows.start is None and rows.stop is None:
            return self
        start, stop = bounds(rows)
        key = self.require_key()
        condition = F.col(key) >= start
        if stop is not None:
            condition = condition & (F.col(key) < stop)
        known = self._n_rows
        if known is not None:
            known = max(0, min(known if stop is None else stop, known) - start)
        kept = self.base.filter(condition).withColumn(key, F.col(key) - F.lit(start).cast("bigint"))
        return self.replace(kept, self.cells, n_rows=known)

    def _columns(self, cols: slice) -> RowMatrix:
        if cols.start is None and cols.stop is None:
            return self
        start, stop = bounds(cols)
        stop = self.n_cols if stop is None else min(stop, self.n_cols)
        length = max(0, stop - start)
        if isinstance(self.cells, Wide):
            kept = Wide(self.cells.names[start : start + length])
            return self.replace(self.base.select(*self._key_columns(), *kept.columns()), kept)
        vec = F.slice(self.cells.array(), start + 1, length).alias(self.cells.name)
        return self.replace(self.base.select(*self._key_columns(), vec), Packed(self.cells.name, length))

    # -- reductions --------------------------------------------------------------------------------------

    def reduce_row_elements(self, op) -> RowMatrix:
        """n x 1 matrix."""
        values = reductions.row_values(self, op)
        return self.replace(values, Wide(("value",)))

    def reduce_col_elements(self, op) -> RowMatrix:
        """1 x m matrix."""
        return reductions.as_row_matrix(self, reductions.col_values(self, op))

    def row_sums(self) -> DataFrame:
        return reductions.row_values(self, "sum")

    def col_sums(self) -> DataFrame:
        return reductions.col_values(self, "sum")

    def reduce_elements(self, op) -> float:
        value = reductions.all_values(self, op).head()
        if value is None or value[0] is None:
            return monoid(op).identity if isinstance(op, str) else float(op.identity)
        return value[0]

    def aggregate_elements(self, zero: tuple, seq_op, comb_op, schema: str) -> tuple:
        return tuple(reductions.fold_elements(self, zero, seq_op, comb_op, schema).head())

    def norm_frobenius(self) -> float:
        return reductions.norm_frobenius(self).head()[0]

    # -- products and factorisations ---------------------------------------------------------------------

    def gram(self) -> DataFrame:
        return products.gram_long(self.base, [self.cells])

    def transpose(self, rows_per_block: int = 512, cols_per_block: int = 512):
        """The transposed matrix as blocks of ``rows_per_block`` x ``cols_per_block`` (of the result).

        Tiles are exchanged in one shuffle: a row of the result has one number per row of this matrix, so it is never
        put together in one place.
        """
        from .sources.grids import to_grid

        return to_grid(self, cols_per_block, rows_per_block).transpose()

    def multiply(self, other, tile: int = block_products.TILE, groups: int | None = None) -> RowMatrix:
        """This matrix times a row matrix or a block matrix, as rows with the same ``row_id``.

        Rows are cut at the other side's inner boundaries and go straight to the tiles of the result. A row is put
        together from its tiles in one more shuffle, or within the task where one tile is as wide as the result.
        """
        from .block_matrix import BlockMatrix

        key, other_dim = self.require_key(), other.dim
        if self.n_cols != other_dim[0]:
            raise ValueError(f"cannot multiply {self.n_rows} x {self.n_cols} by {other_dim[0]} x {other_dim[1]}")
        if isinstance(other, BlockMatrix):
            panels, right = other.row_panels(), block_products.right_blocks(other.df)
        else:
            step = block_products.INNER
            panels = [(i, s, min(step, self.n_cols - s)) for i, s in enumerate(range(0, self.n_cols, step))]
            inner = F.expr(f"int(`{other.require_key()}` div {step})")
            right = block_products.right_rows(other.base, other.require_key(), other.cells, inner, step)
        left = block_products.left_rows(self.base, key, self.cells, panels)
        shape = (self.n_rows, other_dim[1])
        blocks = block_products.multiply(left, right, shape, self.n_cols, tile, groups, fixed_inner=False)
        return block_products.rows_of(blocks, self, shape[1])

    def __matmul__(self, other) -> RowMatrix:
        return self.multiply(other)

    def times_local(self, local: np.ndarray) -> RowMatrix:
        """Product with a matrix that is on the driver. Up to ``products.LOCAL_CELLS`` numbers travel with the tasks; a larger
        one is dealt out as blocks."""
        local = np.asarray(local, dtype=np.float64)
        if local.size > products.LOCAL_CELLS:
            from .sources.grids import blocks_of_local

            return self.multiply(blocks_of_local(self.base.sparkSession, local))
        product = products.times_local(self.base, self.cells, local, self._key_columns(), "vec")
        return self.replace(product, Packed("vec", np.asarray(local).shape[1]))

    def qr_r(self) -> DataFrame:
        from .plans.tall_qr import r_long

        return r_long(self)

    def cond_est(self, r: np.ndarray | None = None) -> float:
        """1-norm condition number, from R when it is already at hand."""
        from .functions.dense import condition_one_norm
        from .plans.tall_qr import local_r

        return condition_one_norm(local_r(self) if r is None else r)

    def svd(self, rank: int | None = None, tolerance: float | None = None):
        """``plans.tall_qr.Svd``: U as a row matrix, the singular values and V."""
        from .plans.tall_qr import svd

        return svd(self, rank, tolerance)

    def norm_2(self) -> float:
        """Largest singular value."""
        from .plans.tall_qr import two_norm

        return two_norm(self).head()[0]

    # -- storage -----------------------------------------------------------------------------------------

    def cache(self) -> RowMatrix:
        self.base.persist(StorageLevel.MEMORY_AND_DISK)
        return self

    def unpersist(self) -> RowMatrix:
        self.base.unpersist()
        return self

    def to_long(self) -> DataFrame:
        """``(i, j, value)``."""
        key = self.require_key()
        return explode_cells(self.base, [F.col(key).alias("i")], self.cells.array(), "j", "value")

    def to_local(self) -> np.ndarray:
        """Dense NumPy copy in row order, refused when it would not fit a local array."""
        if self.length() > INT_MAX:
            raise ValueError(f"cannot collect a matrix of size {self.n_rows} x {self.n_cols} to a local array")
        table = self.df.orderBy(self.require_key()).toArrow()
        values = table.column("vec").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        return values.reshape(table.num_rows, self.n_cols).copy()


def paired_rows(matrices: list[RowMatrix], names: list[str], problem: str) -> DataFrame:
    """``(row_id, name...)``: one array per matrix for each key, in one shuffle however many matrices there are.

    Each key must be there exactly once in every matrix, else the plan raises ``problem`` while it runs.
    """
    stacked = None
    for p, matrix in enumerate(matrices):
        rows = matrix.base.select(
            F.col(matrix.require_key()).alias("row_id"), F.lit(p).alias("source"), matrix.cells.array().alias("vec")
        )
        stacked = rows if stacked is None else stacked.unionByName(rows)
    picked = [F.max(F.when(F.col("source") == p, F.col("vec"))).alias(name) for p, name in enumerate(names)]
    grouped = stacked.groupBy("row_id").agg(F.count(F.lit(1)).alias("found"), *picked)
    complete = F.col("found") == len(names)
    for name in names:
        complete = complete & F.col(name).isNotNull()
    first = F.when(complete, F.col(names[0])).otherwise(F.raise_error(F.lit(problem)).cast("array<double>"))
    return grouped.select("row_id", first.alias(names[0]), *names[1:])


def reciprocal(value: float) -> float:
    with np.errstate(divide="ignore"):
        return float(np.float64(1.0) / np.float64(value))


def bounds(part: slice) -> tuple[int, int | None]:
    """Half-open bounds of a slice; only unit steps from non-negative positions are meaningful here."""
    if part.step not in (None, 1):
        raise ValueError("only contiguous ranges can be selected")
    start = 0 if part.start is None else part.start
    stop = part.stop
    if start < 0 or (stop is not None and stop < 0):
        raise ValueError("ranges count from 0; negative positions are not supported")
    return start, None if stop is None else max(start, stop)
