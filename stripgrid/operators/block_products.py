"""Products of two distributed matrices, and Gram matrices too wide for one task.

The result is cut into square tiles and the inner dimension into groups; a task is one (tile row, tile column, inner
group). Left pieces go to every tile column and right pieces to every tile row, so each side is shuffled once and
replicated as often as the result has tiles on that side: ``tile`` bounds it. A task streams its pieces in order of
the inner block, keeps one inner block of both sides and the tile it adds into, and so adds partial products before
anything else is shuffled. Sums of several inner groups meet in one more shuffle, in a fixed order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrow import matrix_of
from ..layout import Cells, Packed, explode_cells

# Lines of a tile: 2048 x 2048 doubles are 32 MiB in a task.
TILE = 2048
# Inner width at which rows are cut when neither side has blocks.
INNER = 512
# Numbers in one panel of a row strip (4 MiB).
STRIP_CELLS = 2**19

PIECE = ["line", "block", "inner", "inner_start", "height", "width", "vals"]
POSITIONED = "block_row int, block_col int, row_start bigint, col_start bigint, n_rows int, n_cols int, vals array<double>"


def left_blocks(df: DataFrame) -> DataFrame:
    """Blocks as left pieces: ``line`` is the first row, ``inner`` the block column."""
    return df.select(
        F.col("row_start").alias("line"),
        F.col("block_row").alias("block"),
        F.col("block_col").alias("inner"),
        F.col("col_start").alias("inner_start"),
        F.col("n_rows").alias("height"),
        F.col("n_cols").alias("width"),
        "vals",
    )


def right_blocks(df: DataFrame) -> DataFrame:
    """Blocks as right pieces: ``line`` is the first column, ``inner`` the block row."""
    return df.select(
        F.col("col_start").alias("line"),
        F.col("block_col").alias("block"),
        F.col("block_row").alias("inner"),
        F.col("row_start").alias("inner_start"),
        F.col("n_rows").alias("height"),
        F.col("n_cols").alias("width"),
        "vals",
    )


def left_rows(base: DataFrame, key: str, cells: Cells, panels: list[tuple[int, int, int]]) -> DataFrame:
    """Rows as left pieces of height 1, cut at ``panels`` of (id, start, width)."""
    cuts = F.array(
        *[F.struct(F.lit(i).alias("i"), F.lit(s).alias("s"), F.lit(w).alias("w")) for i, s, w in panels]
    )
    pieces = F.transform(
        cuts,
        lambda p: F.struct(
            p["i"].alias("inner"), p["s"].alias("start"), p["w"].alias("width"),
            F.slice(cells.array(), p["s"] + 1, p["w"]).alias("vals"),
        ),
    )
    cut = explode_cells(base, [F.col(key).alias("line")], pieces, "place", "piece")
    return cut.select(
        "line",
        F.lit(0).alias("block"),
        F.col("piece.inner").cast("int").alias("inner"),
        F.col("piece.start").cast("bigint").alias("inner_start"),
        F.lit(1).alias("height"),
        F.col("piece.width").cast("int").alias("width"),
        F.col("piece.vals").alias("vals"),
    )


def right_rows(base: DataFrame, key: str, cells: Cells, inner_of: Column, cols_per_block: int) -> DataFrame:
    """Rows as right pieces of height 1, cut every ``cols_per_block`` columns; ``inner_of`` gives a row's inner block."""
    panels = -(-cells.width // cols_per_block)
    pieces = F.transform(
        F.sequence(F.lit(0), F.lit(panels - 1)),
        lambda p: F.slice(cells.array(), p * cols_per_block + 1, F.lit(cols_per_block)),
    )
    cut = explode_cells(base, [F.col(key).alias("_row"), inner_of.alias("inner")], pieces, "block", "vals")
    return cut.select(
        (F.col("block").cast("bigint") * cols_per_block).alias("line"),
        "block",
        F.col("inner").cast("int").alias("inner"),
        F.col("_row").cast("bigint").alias("inner_start"),
        F.lit(1).alias("height"),
        F.size("vals").alias("width"),
        "vals",
    )


def multiply(
    left: DataFrame,
    right: DataFrame,
    shape: tuple[int, int],
    inner: int,
    tile: int = TILE,
    groups: int | None = None,
    fixed_inner: bool = True,
) -> DataFrame:
    """Blocks ``(block_row, block_col, row_start, ...)`` of the product of left and right pieces.

    ``shape`` is that of the result, ``inner`` the common size. ``groups`` is the number of inner groups; by default
    just enough for every core to have a task. ``fixed_inner`` demands that an inner block has the same extent on both
    sides (blocks); row pieces may leave rows out, which then count as zero.
    """
    tile_rows, tile_cols = max(1, -(-shape[0] // tile)), max(1, -(-shape[1] // tile))
    groups = _inner_groups(left, tile_rows * tile_cols, groups, inner)
    own = F.expr(f"int(line div {tile})")
    group = F.pmod(F.col("inner"), F.lit(groups)).cast("int").alias("grp")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    first = left.select(own.alias("p"), every(tile_cols).alias("q"), group, F.lit(0).alias("side"), *PIECE)
    then = right.select(every(tile_rows).alias("p"), own.alias("q"), group, F.lit(1).alias("side"), *PIECE)
    return _sum_tiles(first.unionByName(then), groups, False, fixed_inner)


def _inner_groups(frame: DataFrame, tiles: int, groups: int | None, most: int | None = None) -> int:
    if groups is None:
        groups = -(-frame.sparkSession.sparkContext.defaultParallelism // tiles)
    return max(1, groups if most is None else min(groups, most))


def _sum_tiles(dealt: DataFrame, groups: int, transposed_left: bool, fixed_inner: bool) -> DataFrame:
    """The products of pieces that were dealt to tiles. Pieces meet in the order of ``inner`` and ``line``, so sums have the
    same order in every run."""
    order = ["p", "q", "grp", "inner", "side", "inner_start", "line"]
    sorted_pieces = dealt.repartition("p", "q", "grp").sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = _TileSums(transposed_left, fixed_inner)
        for batch in batches:
            names = ["p", "q", "grp", "side", *PIECE[:-1]]
            places = zip(*(batch.column(name).to_pylist() for name in names))
            for place, vals in zip(places, batch.column("vals")):
                yield from sums.take(place, vals.values.to_numpy())
        yield from sums.close()

    product = sorted_pieces.mapInArrow(run, "grp int, " + POSITIONED)
    if groups == 1:
        return product.drop("grp")
    keyed = product.repartition("row_start", "col_start").sortWithinPartitions("row_start", "col_start", "grp")
    return keyed.mapInArrow(_add_groups, POSITIONED)


class _Slab:
    """The pieces of one side that share an inner block, put side by side."""

    def __init__(self):
        self.pieces: list[tuple] = []

    def add(self, line, block, start, height, width, vals) -> None:
        self.pieces.append((line, block, start, height, width, vals))

    def dense(self, across_rows: bool, low: int, high: int) -> tuple[list[tuple], np.ndarray]:
        """(lines, matrix). ``across_rows``: lines are rows and inner positions columns; else the other way round."""
        lines: dict[int, tuple] = {}
        for line, block, _, height, width, _ in self.pieces:
            lines.setdefault(line, (line, block, height if across_rows else width))
        ordered = [lines[line] for line in sorted(lines)]
        at, total = {}, 0
        for line, _, size in ordered:
            at[line], total = total, total + size
        whole = np.zeros((total, high - low) if across_rows else (high - low, total))
        for line, _, start, height, width, vals in self.pieces:
            part = vals.reshape(height, width)
            if across_rows:
                whole[at[line] : at[line] + height, start - low : start - low + width] = part
            else:
                whole[start - low : start - low + height, at[line] : at[line] + width] = part
        return ordered, whole


class _TileSums:
    """Adds up the products of one task, tile by tile."""

    def __init__(self, transposed_left: bool, fixed_inner: bool):
        self.transposed_left, self.fixed_inner = transposed_left, fixed_inner
        self.tile = self.inner = self.total = self.lines = None
        self.done: dict[tuple, np.ndarray] = {}
        self.sides = (_Slab(), _Slab())

    def take(self, place: tuple, vals: np.ndarray):
        p, q, grp, side, line, block, inner, start, height, width = place
        if (p, q, grp) != self.tile:
            yield from self.close()
            self.tile = (p, q, grp)
        if inner != self.inner:
            self.finish_inner()
            self.inner = inner
        self.sides[side].add(line, block, start, height, width, vals)

    def finish_inner(self) -> None:
        left, right = self.sides
        self.sides = (_Slab(), _Slab())
        if not left.pieces or not right.pieces:
            return  # an inner block that one side doesn't store is zero
        size = 3 if self.transposed_left else 4
        extents = [
            (min(x[2] for x in slab.pieces), max(x[2] + x[k] for x in slab.pieces)) for slab, k in ((left, size), (right, 3))
        ]
        if self.fixed_inner and extents[0] != extents[1]:
            raise ValueError(f"inner blocks differ: {extents[0]} on the left and {extents[1]} on the right")
        low, high = min(x[0] for x in extents), max(x[1] for x in extents)
        rows, a = left.dense(not self.transposed_left, low, high)
        cols, b = right.dense(False, low, high)
        product = (a.T if self.transposed_left else a) @ b
        if self.lines == (rows, cols):
            self.total += product
        else:
            self.spread()
            self.total, self.lines = product, (rows, cols)

    def spread(self) -> None:
        """Move the running sum into blocks; only pieces that are not stored everywhere make this happen early."""
        if self.lines is None:
            return
        rows, cols = self.lines
        top = 0
        for row, block_row, height in rows:
            left = 0
            for col, block_col, width in cols:
                part = self.total[top : top + height, left : left + width]
                key = (row, col, block_row, block_col)
                self.done[key] = self.done[key] + part if key in self.done else part
                left += width
            top += height
        self.total = self.lines = None

    def close(self):
        self.finish_inner()
        self.spread()
        if self.done:
            yield from _blocks(self.done, self.tile[2])
        self.done, self.inner = {}, None


def _blocks(done: dict[tuple, np.ndarray], group: int) -> Iterator[pa.RecordBatch]:
    """Batches of blocks, about 16 MiB each."""
    keys = sorted(done)
    while keys:
        taken, size = [], 0
        while keys and (not taken or size + done[keys[0]].size <= 2 * 2**20):
            taken.append(keys.pop(0))
            size += done[taken[-1]].size
        parts = [done[key] for key in taken]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([group] * len(taken), pa.int32()),
                pa.array([k[2] for k in taken], pa.int32()),
                pa.array([k[3] for k in taken], pa.int32()),
                pa.array([k[0] for k in taken], pa.int64()),
                pa.array([k[1] for k in taken], pa.int64()),
                pa.array([x.shape[0] for x in parts], pa.int32()),
                pa.array([x.shape[1] for x in parts], pa.int32()),
                lists_of_parts(parts),
            ],
            ["grp", "block_row", "block_col", "row_start", "col_start", "n_rows", "n_cols", "vals"],
        )


def _add_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Add the blocks of the inner groups; they arrive together and in order."""
    names = ["row_start", "col_start", "block_row", "block_col", "n_rows", "n_cols"]
    held, total = None, None

    def row() -> pa.RecordBatch:
        key, part = held[:4], total.reshape(held[4:])
        (batch,) = _blocks({key: part}, 0)
        return batch.select([n for n in batch.schema.names if n != "grp"])

    for batch in batches:
        for place, vals in zip(zip(*(batch.column(n).to_pylist() for n in names)), batch.column("vals")):
            if place == held:
                total = total + vals.values.to_numpy()
            else:
                if held is not None:
                    yield row()
                held, total = place, vals.values.to_numpy()
    if held is not None:
        yield row()


def transpose(df: DataFrame) -> DataFrame:
    """Blocks of the transposed matrix: positions swapped, values turned inside each block. No shuffle."""
    turned = df.select(
        F.col("block_col").alias("block_row"),
        F.col("block_row").alias("block_col"),
        F.col("col_start").alias("row_start"),
        F.col("row_start").alias("col_start"),
        F.col("n_cols").alias("n_rows"),
        F.col("n_rows").alias("n_cols"),
        "vals",
    )

    at = turned.columns.index("vals")

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = zip(batch.column("n_cols").to_pylist(), batch.column("n_rows").to_pylist())
            parts = [v.values.to_numpy().reshape(size).T for v, size in zip(batch.column("vals"), sizes)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], lists_of_parts(parts)], batch.schema.names)

    return turned.mapInArrow(turn, turned.schema)


def gram_blocks(frame: DataFrame, parts: list[Cells], tile: int = TILE, groups: int | None = None) -> DataFrame:
    """Blocks of the Gram matrix on and above the diagonal, for any width: a sum of outer products of row strips.

    A task cuts the rows it reads into strips of a few MiB and each strip into panels of ``tile`` columns; panels a and b of
    a strip meet in tile (a, b). Rows move once per tile column; no task holds more than a tile.
    """
    width = sum(part.width for part in parts)
    panels = max(1, -(-width // tile))
    height = max(1, STRIP_CELLS // min(tile, max(1, width)))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        strip = TaskContext.get().partitionId() << 32
        for batch in batches:
            for start in range(0, batch.num_rows, height):
                rows = matrix_of(batch.slice(start, height), parts)
                panel = [rows[:, b * tile : (b + 1) * tile] for b in range(panels)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([b * tile for b in range(panels)], pa.int64()),
                        pa.array(range(panels), pa.int32()),
                        pa.array([strip] * panels, pa.int64()),
                        pa.array([0] * panels, pa.int64()),
                        pa.array([len(rows)] * panels, pa.int32()),
                        pa.array([x.shape[1] for x in panel], pa.int32()),
                        lists_of_parts(panel),
                    ],
                    PIECE,
                )
                strip += 1

    schema = "line bigint, block int, inner bigint, inner_start bigint, height int, width int, vals array<double>"
    columns = [column for part in parts for column in part.columns()]
    pieces = frame.select(*columns).mapInArrow(cut, schema)
    groups = _inner_groups(frame, panels * (panels + 1) // 2, groups)
    # Both roles of a piece come from one evaluation, so the two sides hold the same strips.
    role = lambda p, q, side: F.struct(p.alias("p"), q.alias("q"), F.lit(side).alias("side"))
    block = F.col("block")
    roles = F.concat(
        F.transform(F.sequence(block, F.lit(panels - 1)), lambda q: role(block, q, 0)),
        F.transform(F.sequence(F.lit(0), block), lambda p: role(p, block, 1)),
    )
    group = F.pmod(F.xxhash64("inner"), F.lit(groups)).cast("int").alias("grp")
    dealt = pieces.select(F.explode(roles).alias("role"), group, *PIECE).select("role.*", "grp", *PIECE)
    return _sum_tiles(dealt, groups, True, True)


def gram_cells(blocks: DataFrame) -> DataFrame:
    """``(i, j, value)`` of the whole square from the blocks on and above the diagonal."""
    cells = explode_cells(blocks, ["row_start", "col_start", "n_cols"], F.col("vals"), "pos", "value").select(
        (F.col("row_start") + F.expr("pos div n_cols")).cast("int").alias("i"),
        (F.col("col_start") + F.col("pos") % F.col("n_cols")).cast("int").alias("j"),
        (F.col("col_start") > F.col("row_start")).alias("above"),
        "value",
    )
    both = F.array(F.struct("i", "j"), F.when(F.col("above"), F.struct(F.col("j").alias("i"), F.col("i").alias("j"))))
    return cells.select(F.explode(both).alias("at"), "value").where("at is not null").select("at.i", "at.j", "value")


def rows_of(blocks: DataFrame, like, width: int):
    """Rows from blocks of height 1; columns that no block holds are zero. A group is one row."""
    pieces = F.sort_array(F.collect_list(F.struct("col_start", "n_cols", "vals")))
    rows = blocks.groupBy(F.col("row_start").alias("row_id")).agg(pieces.alias("pieces"))
    whole = F.flatten("pieces.vals")
    # Only sparse right sides leave columns out; then every piece is put at its place by padding what lies before.
    starts = F.transform(F.col("pieces"), lambda x, i: x["col_start"] - F.when(
        i == 0, 0).otherwise(F.try_element_at("pieces", i)["col_start"] + F.try_element_at("pieces", i)["n_cols"]))
    padded = F.flatten(F.zip_with(starts, F.col("pieces"), lambda gap, x: F.concat(F.array_repeat(F.lit(0.0), gap.cast("int")), x["vals"])))
    padded = F.concat(padded, F.array_repeat(F.lit(0.0), F.lit(width) - F.size(padded)))
    vec = F.when(F.size(whole) == width, whole).otherwise(padded)
    return like.replace(rows.select("row_id", vec.alias("vec")), Packed("vec", width), key="row_id")


def lists_of_parts(parts: list[np.ndarray]) -> pa.Array:
    """One list of doubles per matrix, row-major."""
    ends = np.cumsum([0, *[x.size for x in parts]]).astype(np.int32)
    flat = np.concatenate([x.ravel() for x in parts]) if parts else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
