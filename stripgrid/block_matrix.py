"""A dense matrix stored as a two-dimensional grid of blocks."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions.monoids import monoid
from .layout import Packed, Wide, explode_cells
from .operators import block_products, block_reductions
from .operators.reductions import root_of_squares
from .row_matrix import INT_MAX, RowMatrix, bounds, reciprocal

POSITION = ["block_row", "block_col", "row_start", "col_start", "n_rows", "n_cols"]


@dataclass(frozen=True)
class Steps:
    """Block boundaries along one direction: a first block of ``lead`` lines, then blocks of ``size`` lines."""

    lead: int
    size: int

    def start(self, block: int) -> int:
        return 0 if block == 0 else self.lead + (block - 1) * self.size

    def block_of(self, line: int) -> int:
        return 0 if line < self.lead else 1 + (line - self.lead) // self.size

    def edges(self, size: int) -> list[int]:
        """Start of every block of ``size`` lines, and the end of the last one."""
        blocks = self.block_of(size - 1) + 1 if size else 0
        return [self.start(block) for block in range(blocks)] + [size]

    def after(self, line: int) -> Steps:
        """Boundaries of what is left when everything before ``line`` is cut off."""
        return Steps(self.start(self.block_of(line) + 1) - line, self.size)


class BlockMatrix:
    """Handle over ``(block_row, block_col, row_start, col_start, n_rows, n_cols, vals)``; ``vals`` is row-major.

    Every block carries its own position, so slices are filters that reach the scan and need no block directory.
    ``steps`` states regular boundaries (rows, columns) when they are known; renumbering is then arithmetic.
    """

    def __init__(
        self,
        df: DataFrame,
        dim: tuple[int, int] | Callable[[], tuple[int, int]] | None = None,
        steps: tuple[Steps | None, Steps | None] = (None, None),
    ):
        self.df = df.select(*POSITION, "vals")
        self._dim = dim
        self.row_steps, self.col_steps = steps

    @property
    def steps(self) -> tuple[Steps | None, Steps | None]:
        return self.row_steps, self.col_steps

    def with_vals(self, vals: Column) -> BlockMatrix:
        return BlockMatrix(self.df.select(*POSITION, vals.alias("vals")), self._dim, self.steps)

    # -- shape -------------------------------------------------------------------------------------------

    @property
    def dim(self) -> tuple[int, int]:
        """Size. Where it isn't known, ``dim`` may be a function that finds it more cheaply than the blocks would."""
        if callable(self._dim):
            self._dim = self._dim()
        if self._dim is None:
            row = self.dims().head()
            self._dim = (row.n_rows, row.n_cols)
        return self._dim

    @property
    def n_rows(self) -> int:
        return self.dim[0]

    @property
    def n_cols(self) -> int:
        return self.dim[1]

    def length(self) -> int:
        return self.n_rows * self.n_cols

    def dims(self) -> DataFrame:
        """One row ``(n_rows, n_cols)`` from block positions; block values are not read."""
        extents = self.df.agg(
            F.max(F.col("row_start") + F.col("n_rows")).alias("n_rows"),
            F.max(F.col("col_start") + F.col("n_cols")).alias("n_cols"),
        )
        return extents.select(*[F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c) for c in ("n_rows", "n_cols")])

    def directory(self) -> DataFrame:
        """One row per block: position and extent."""
        return self.df.select(*POSITION)

    def column_panels(self) -> list[tuple[int, int, int]]:
        """``(block_col, col_start, n_cols)`` per block column; as many entries as the grid is wide."""
        if self.col_steps is not None and self._dim is not None:
            edges = self.col_steps.edges(self.n_cols)
            return [(j, start, end - start) for j, (start, end) in enumerate(zip(edges, edges[1:]))]
        panels = self.df.select("block_col", "col_start", "n_cols").distinct().orderBy("block_col").collect()
        return [tuple(row) for row in panels]

    def row_panels(self) -> list[tuple[int, int, int]]:
        """``(block_row, row_start, n_rows)`` per block row: by arithmetic where the boundaries are known, else one entry
        per block row from the positions."""
        if self.row_steps is not None:
            edges = self.row_steps.edges(self.n_rows)
            return [(i, start, end - start) for i, (start, end) in enumerate(zip(edges, edges[1:]))]
        panels = self.df.select("block_row", "row_start", "n_rows").distinct().orderBy("block_row").collect()
        return [tuple(row) for row in panels]

    # -- element-wise ------------------------------------------------------------------------------------

    def map_elements(self, fn: Callable[[Column], Column]) -> BlockMatrix:
        """``fn`` maps a Column to a Column. A NULL result is an error; use NaN."""
        null = F.raise_error(F.lit("an element map gave NULL")).cast("double")
        return self.with_vals(F.transform("vals", lambda x: F.coalesce(fn(x).cast("double"), null)))

    def pow(self, exponent: float) -> BlockMatrix:
        return self.map_elements(lambda x: F.pow(x, F.lit(float(exponent))))

    def __add__(self, other) -> BlockMatrix:
        if isinstance(other, (int, float)):
            return self.map_elements(lambda x: x + F.lit(float(other)))
        return self._zip(other, lambda x, y: x + y)

    def __sub__(self, other) -> BlockMatrix:
        if isinstance(other, (int, float)):
            return self + (-float(other))
        return self._zip(other, lambda x, y: x - y)

    def __mul__(self, other: float) -> BlockMatrix:
        return self.map_elements(lambda x: x * F.lit(float(other)))

    def __truediv__(self, other: float) -> BlockMatrix:
        return self * reciprocal(other)

    def _zip(self, other, fn: Callable[[Column, Column], Column]) -> BlockMatrix:
        """Blocks matched on their grid position; the two grids must have the same blocks and extents."""
        if not isinstance(other, BlockMatrix):
            raise TypeError("cannot combine matrices of different types")
        right = other.df.select(
            "block_row",
            "block_col",
            *[F.col(name).alias(f"other_{name}") for name in (*POSITION[2:], "vals")],
        )
        same = F.col("vals").isNotNull() & F.col("other_vals").isNotNull()
        for name in POSITION[2:]:
            same = same & (F.col(name) == F.col(f"other_{name}"))
        vals = F.when(same, F.zip_with("vals", "other_vals", fn)).otherwise(
            F.raise_error(F.lit("cannot combine matrices with unequal blocks")).cast("array<double>")
        )
        joined = self.df.join(right, ["block_row", "block_col"], "full_outer")
        return BlockMatrix(joined.select(*POSITION, vals.alias("vals")), self._dim, self.steps)

    # -- products ----------------------------------------------------------------------------------------

    def transpose(self) -> BlockMatrix:
        """Blocks change places and are turned inside; nothing is shuffled."""
        dim = self._dim if self._dim is None or callable(self._dim) else self._dim[::-1]
        if callable(dim):
            dim = lambda: self.dim[::-1]
        return BlockMatrix(block_products.transpose(self.df), dim, self.steps[::-1])

    @property
    def T(self) -> BlockMatrix:
        return self.transpose()

    def multiply(self, other: BlockMatrix, tile: int = block_products.TILE, groups: int | None = None) -> BlockMatrix:
        """Matrix product. The column blocks of this matrix must be cut like the row blocks of the other.

        ``tile`` is the side of the result tiles that a task adds into, ``groups`` the number of parts of the inner
        dimension whose sums meet in a second shuffle (see ``operators.block_products``).
        """
        if not isinstance(other, BlockMatrix):
            raise TypeError("a block matrix can be multiplied by a block matrix")
        if self.n_cols != other.n_rows:
            raise ValueError(f"cannot multiply {self.n_rows} x {self.n_cols} by {other.n_rows} x {other.n_cols}")
        shape, inner = (self.n_rows, other.n_cols), self.n_cols
        if self.col_steps and other.row_steps and self.col_steps.edges(inner) != other.row_steps.edges(inner):
            raise ValueError("cut both sides at the same inner positions before multiplying")
        left, right = block_products.left_blocks(self.df), block_products.right_blocks(other.df)
        blocks = block_products.multiply(left, right, shape, inner, tile, groups)
        return BlockMatrix(blocks, shape, (self.row_steps, other.col_steps))

    def __matmul__(self, other: BlockMatrix) -> BlockMatrix:
        return self.multiply(other)

    # -- selection ---------------------------------------------------------------------------------------

    def __getitem__(self, ranges) -> BlockMatrix:
        """``m[a:b, c:d]`` with half-open element ranges; kept blocks are renumbered from 0."""
        rows, cols = ranges
        return self._rows(rows)._columns(cols)

    def _rows(self, rows: slice) -> BlockMatrix:
        if rows.start is None and rows.stop is None:
            return self
        start, stop = bounds(rows)
        stop = INT_MAX * INT_MAX if stop is None else stop
        kept = self.df.filter(_blocks_between("block_row", self.row_steps, start, stop))
        kept = kept.filter((F.col("row_start") < stop) & (F.col("row_start") + F.col("n_rows") > start))
        low = F.greatest(F.lit(start) - F.col("row_start"), F.lit(0)).cast("int")
        high = F.least(F.lit(stop) - F.col("row_start"), F.col("n_rows").cast("bigint")).cast("int")
        cut = kept.withColumns({"low": low, "height": F.greatest(high - low, F.lit(0))})
        sliced = F.slice("vals", F.col("low") * F.col("n_cols") + 1, F.col("height") * F.col("n_cols"))
        return BlockMatrix(
            cut.select(
                (F.col("block_row") - _first(kept, "block_row", self.row_steps, start)).alias("block_row"),
                "block_col",
                F.greatest(F.col("row_start") - start, F.lit(0)).cast("bigint").alias("row_start"),
                "col_start",
                F.col("height").alias("n_rows"),
                "n_cols",
                F.when(F.col("height") == F.col("n_rows"), F.col("vals")).otherwise(sliced).alias("vals"),
            ).filter("n_rows > 0"),
            steps=(self.row_steps.after(start) if self.row_steps else None, self.col_steps),
        )

    def _columns(self, cols: slice) -> BlockMatrix:
        if cols.start is None and cols.stop is None:
            return self
        start, stop = bounds(cols)
        stop = INT_MAX * INT_MAX if stop is None else stop
        kept = self.df.filter(_blocks_between("block_col", self.col_steps, start, stop))
        kept = kept.filter((F.col("col_start") < stop) & (F.col("col_start") + F.col("n_cols") > start))
        low = F.greatest(F.lit(start) - F.col("col_start"), F.lit(0)).cast("int")
        high = F.least(F.lit(stop) - F.col("col_start"), F.col("n_cols").cast("bigint")).cast("int")
        cut = kept.withColumns({"low": low, "width": F.greatest(high - low, F.lit(0))})
        sliced = F.flatten(
            F.transform(
                F.sequence(F.lit(0), F.col("n_rows") - 1),
                lambda r: F.slice(F.col("vals"), r * F.col("n_cols") + F.col("low") + 1, F.col("width")),
            )
        )
        # The slice is computed before n_cols gets its new meaning: names in a lambda would see the new alias.
        cut = cut.withColumn("vals", F.when(F.col("width") == F.col("n_cols"), F.col("vals")).otherwise(sliced))
        return BlockMatrix(
            cut.select(
                "block_row",
                (F.col("block_col") - _first(kept, "block_col", self.col_steps, start)).alias("block_col"),
                "row_start",
                F.greatest(F.col("col_start") - start, F.lit(0)).cast("bigint").alias("col_start"),
                "n_rows",
                F.col("width").alias("n_cols"),
                "vals",
            ).filter("n_cols > 0"),
            steps=(self.row_steps, self.col_steps.after(start) if self.col_steps else None),
        )

    def block_range(self, row_from: int, row_to: int, col_from: int, col_to: int) -> BlockMatrix:
        """Half-open range of the grid, renumbered so that the first block is (0, 0)."""
        kept = self.df.filter(
            (F.col("block_row") >= row_from)
            & (F.col("block_row") < row_to)
            & (F.col("block_col") >= col_from)
            & (F.col("block_col") < col_to)
        )
        return BlockMatrix(
            kept.select(
                (F.col("block_row") - row_from).alias("block_row"),
                (F.col("block_col") - col_from).alias("block_col"),
                (F.col("row_start") - _origin(kept, "row_start", self.row_steps, row_from)).alias("row_start"),
                (F.col("col_start") - _origin(kept, "col_start", self.col_steps, col_from)).alias("col_start"),
                "n_rows",
                "n_cols",
                "vals",
            ),
            steps=(
                self.row_steps.after(self.row_steps.start(row_from)) if self.row_steps else None,
                self.col_steps.after(self.col_steps.start(col_from)) if self.col_steps else None,
            ),
        )

    def col_block(self, block_col: int, width: int | None = None) -> RowMatrix:
        """One column of blocks as a row matrix."""
        kept = self.df.filter(F.col("block_col") == block_col)
        if width is None:
            first = kept.select("n_cols").head()
            width = 0 if first is None else first.n_cols
        return RowMatrix(block_rows(kept).select("row_id", "vec"), Packed("vec", width))

    def to_rows(self) -> RowMatrix:
        """Rows put together from their blocks; blocks that are not stored count as zero.

        One group holds the pieces of one row, so its size is the width of the matrix.
        """
        panels = self.column_panels()
        pieces = block_rows(self.df).groupBy("row_id").agg(
            F.map_from_entries(F.collect_list(F.struct("block_col", "vec"))).alias("pieces")
        )
        order = F.array(*[F.struct(F.lit(c).alias("c"), F.lit(width).alias("width")) for c, _, width in panels])
        filled = F.transform(
            order,
            lambda p: F.coalesce(F.try_element_at("pieces", p["c"]), F.array_repeat(F.lit(0.0), p["width"])),
        )
        rows = pieces.select("row_id", F.flatten(filled).alias("vec"))
        return RowMatrix(rows, Packed("vec", sum(width for _, _, width in panels)))

    # -- reductions --------------------------------------------------------------------------------------

    def reduce_row_elements(self, op) -> BlockMatrix:
        """n x 1 matrix, one block per block row."""
        return BlockMatrix(block_reductions.by_row(self.df, op))

    def reduce_col_elements(self, op) -> BlockMatrix:
        """1 x m matrix, one block per block column."""
        return BlockMatrix(block_reductions.by_column(self.df, op))

    def row_sums(self) -> DataFrame:
        """``(row_id, value)``."""
        return self.reduce_row_elements("sum").to_long().select(F.col("i").alias("row_id"), "value")

    def col_sums(self) -> DataFrame:
        """``(j, value)``."""
        return self.reduce_col_elements("sum").to_long().select("j", "value")

    def reduce_elements(self, op) -> float:
        value = block_reductions.of_all(self.df, op).head()
        if value is None or value[0] is None:
            return monoid(op).identity if isinstance(op, str) else float(op.identity)
        return value[0]

    def aggregate_elements(self, zero: tuple, seq_op, comb_op, schema: str) -> tuple:
        return self._elements().aggregate_elements(zero, seq_op, comb_op, schema)

    def _elements(self) -> RowMatrix:
        """All elements as an n x 1 matrix without positions, for whole-matrix operators."""
        cells = explode_cells(self.df, [], F.col("vals"), "pos", "value")
        return RowMatrix(cells.select("value"), Wide(("value",)), key=None)

    def norm_frobenius(self) -> float:
        return self.norm_frame().head()[0]

    def norm_frame(self) -> DataFrame:
        """One row ``(value)``: Frobenius norm."""
        return root_of_squares(self.df, Packed("vals", 0))

    # -- storage -----------------------------------------------------------------------------------------

    def qr_r(self, route: str = "auto") -> BlockMatrix:
        from .plans.block_qr import block_qr_r

        return block_qr_r(self, route)

    def cache(self) -> BlockMatrix:
        self.df.persist(StorageLevel.MEMORY_AND_DISK)
        return self

    def unpersist(self) -> BlockMatrix:
        self.df.unpersist()
        return self

    def to_long(self) -> DataFrame:
        """``(i, j, value)`` with global positions."""
        cells = explode_cells(self.df, ["row_start", "col_start", "n_cols"], F.col("vals"), "pos", "value")
        return cells.select(
            (F.col("row_start") + F.expr("pos div n_cols")).alias("i"),
            (F.col("col_start") + F.col("pos") % F.col("n_cols")).cast("int").alias("j"),
            "value",
        )

    def to_local(self) -> np.ndarray:
        if self.length() > INT_MAX:
            raise ValueError(f"cannot collect a matrix of size {self.n_rows} x {self.n_cols} to a local array")
        local = np.zeros(self.dim)
        for batch in self.df.toArrow().to_batches():
            places = zip(*(batch.column(name).to_pylist() for name in POSITION[2:]))
            for (top, left, height, width), vals in zip(places, batch.column("vals")):
                local[top : top + height, left : left + width] = vals.values.to_numpy().reshape(height, width)
        return local


def block_rows(df: DataFrame) -> DataFrame:
    """``(row_id, block_row, block_col, vec)``: one row per matrix row and block column."""
    rows = F.transform(
        F.sequence(F.lit(0), F.col("n_rows") - 1),
        lambda r: F.slice(F.col("vals"), r * F.col("n_cols") + 1, F.col("n_cols")),
    )
    return explode_cells(df, ["block_row", "block_col", "row_start"], rows, "offset", "vec").select(
        (F.col("row_start") + F.col("offset")).alias("row_id"), "block_row", "block_col", "vec"
    )


def _blocks_between(name: str, steps: Steps | None, start: int, stop: int) -> Column:
    """Element bounds as bounds on block ids, where boundaries are known: these prune folders and row groups of stored
    blocks, and they are on a grouping key of ``to_grid``, so they are applied before its shuffle."""
    if steps is None:
        return F.lit(True)
    last = min(steps.block_of(stop - 1), INT_MAX) if stop > start else -1
    return (F.col(name) >= min(steps.block_of(start), INT_MAX)) & (F.col(name) <= last)


def _first(kept: DataFrame, name: str, steps: Steps | None, line: int) -> Column:
    """Id of the first kept block."""
    return F.lit(steps.block_of(line)).cast("int") if steps else _least(kept, name)


def _origin(kept: DataFrame, name: str, steps: Steps | None, block: int) -> Column:
    """Position of the first kept line."""
    return F.lit(steps.start(block)).cast("bigint") if steps else _least(kept, name)


def _least(df: DataFrame, name: str) -> Column:
    """Smallest value of a position column as a scalar subquery; reads positions only."""
    return df.select(F.min(name).alias("least")).scalar()
