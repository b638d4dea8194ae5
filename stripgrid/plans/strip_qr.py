"""Block QR on row strips: all blocks of a block row stay in one place, so the matrix is dealt once and never moved again.

Per panel P with the columns T to its right, and R1 (the R factor of P) known from the pass before:

* pass A sums Q1'[Q1 | T] for Q1 = P R1^-1. Q1'Q1 is near the identity, so its Cholesky factor R2 makes Q = Q1 R2^-1
  orthonormal, and S = R2^-T Q1'T is the rest of the panel's rows of R.
* pass B sums S2 = Q'(T - Q S), what rounding has left in the panel's directions.
* pass C stores T - Q S - Q S2, and beside it the task's share of the next panel's R factor.

Each pass is a narrow map over stored strips; only sums of ``panel x columns`` numbers meet in merge trees. The number of
jobs for a panel does not depend on the size of the matrix.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrow import keyed_rows, matrix_to_lists
from ..functions.dense import condition_two_norm
from ..functions.lineage import cut_lineage
from ..operators.block_products import POSITIONED, lists_of_parts
from ..operators.folding import PARTIAL_SCHEMA, RFactor, merge_tree
from .tall_qr import PROJECTED_LIMIT, collect_square, divide_right

# Numbers in one row of blocks of R: it is held by a task, and by the driver between passes (128 MiB).
MOST_CELLS = 2**24
# Rows of R of up to so many numbers stay in the plan; larger ones are written down.
LOCAL_CELLS = 2**17

_STRIPS = "block_row int, block_col int, n_rows int, vals array<double>, part int, i int, vec array<double>"
Panel = tuple[int, int, int]


class NearlyDependent(Exception):
    """A panel whose Q cannot be had by projection."""


class AddRows:
    """Sum of equally shaped small matrices that arrive row by row."""

    gather = 1

    def merge(self, state: np.ndarray | None, index: np.ndarray, rows: np.ndarray) -> np.ndarray:
        height = int(index.max()) + 1
        total = np.zeros((max(height, 0 if state is None else len(state)), rows.shape[1]))
        if state is not None:
            total[: len(state)] = state
        np.add.at(total, index, rows)
        return total


def fits_strips(panels: list[Panel]) -> bool:
    columns = sum(width for _, _, width in panels)
    return all(width * columns <= MOST_CELLS for _, _, width in panels)


def strip_qr_r(blocks: DataFrame, panels: list[Panel], n_rows: int) -> DataFrame:
    """Blocks of R. Raises ``NearlyDependent`` where a panel needs the direct route."""
    dealt = blocks.select("block_row", "block_col", "n_rows", "vals").repartition("block_row")
    dealt = dealt.sortWithinPartitions("block_row", "block_col")
    stored = _store(dealt, panels, None)
    pieces: list[DataFrame] = []
    for p, (block_col, start, width) in enumerate(panels):
        if start >= n_rows:
            break
        height, rest = min(width, n_rows - start), panels[p + 1 :]
        columns = sum(w for _, _, w in rest)
        partials = stored.where("part is not null").select("part", F.lit(0).alias("key"), "i", "vec")
        r_first = collect_square(merge_tree(partials, RFactor(width), width**2), width)
        if not rest:
            pieces.append(_row_of_r(blocks, r_first[:height], panels[p:], block_col, start))
            break
        if condition_two_norm(r_first) >= PROJECTED_LIMIT:
            raise NearlyDependent
        strips = stored.where("part is null").drop("part", "i", "vec")
        sums = _sums(strips, panels[p:], lambda q, t: np.hstack([q.T @ q, q.T @ t]), [r_first], None, width + columns)
        r_second = np.linalg.cholesky(sums[:, :width]).T
        s = np.linalg.solve(r_second.T, sums[:, width:])
        factors = [r_first, r_second]
        more = _sums(strips, panels[p:], lambda q, t: q.T @ t, factors, s, columns)
        whole = np.hstack([np.triu(r_second @ r_first), s + more])
        pieces.append(_row_of_r(blocks, whole[:height], panels[p:], block_col, start))
        stored = _store(strips, panels[p:], (factors, s, more))
    result = pieces[0]
    for piece in pieces[1:]:
        result = result.unionByName(piece)
    return result


def _strips_of(batches: Iterator[pa.RecordBatch], panels: list[Panel]) -> Iterator[tuple[int, np.ndarray]]:
    """(block row, dense strip) in the order of the panels' columns; blocks that are not stored count as zero."""
    first, total = panels[0][1], sum(width for _, _, width in panels)
    places = {block_col: (start - first, width) for block_col, start, width in panels}
    held, strip = None, None
    for batch in batches:
        columns = (batch.column(name).to_pylist() for name in ("block_row", "block_col", "n_rows"))
        for block_row, block_col, n_rows, vals in zip(*columns, batch.column("vals")):
            if block_col not in places:
                continue  # a panel that is done
            if block_row != held:
                if held is not None:
                    yield held, strip
                held, strip = block_row, np.zeros((n_rows, total))
            at, width = places[block_col]
            strip[:, at : at + width] = vals.values.to_numpy().reshape(n_rows, width)
    if held is not None:
        yield held, strip


def _parted(strip: np.ndarray, width: int, factors, s) -> tuple[np.ndarray, np.ndarray]:
    """Q of the panel in this strip, and the columns to its right without the panel's directions (given S)."""
    q, rest = divide_right(strip[:, :width], factors), strip[:, width:]
    return q, rest if s is None else rest - q @ s


def _sums(strips: DataFrame, panels: list[Panel], product, factors, s, columns: int) -> np.ndarray:
    """A sum over all strips of ``product(Q, T)``, on the driver: panel x columns numbers."""
    width = panels[0][2]

    def partial(batches):
        total = None
        for _, strip in _strips_of(batches, panels):
            part = product(*_parted(strip, width, factors, s))
            total = part if total is None else total + part
        if total is not None:
            yield from keyed_rows({"part": TaskContext.get().partitionId(), "key": 0}, total)

    partials = strips.mapInArrow(partial, PARTIAL_SCHEMA)
    return collect_square(merge_tree(partials, AddRows(), width * columns), columns)


def _store(strips: DataFrame, panels: list[Panel], update) -> DataFrame:
    """Strips after the update of a panel (None: as they are), and each task's R factor of the panel that comes next,
    written down in one pass. Order and partitioning stay as they are."""
    after = panels if update is None else panels[1:]
    width, next_width = panels[0][2], after[0][2]
    fold = RFactor(next_width)
    edges = np.cumsum([0, *[w for _, _, w in after]])

    def run(batches):
        state, waiting = None, []

        def settle():
            nonlocal state, waiting
            rows = np.vstack([*([] if state is None else [state]), *waiting])
            state, waiting = fold.start(rows), []

        for block_row, strip in _strips_of(batches, panels):
            if update is not None:
                factors, s, more = update
                q, strip = _parted(strip, width, factors, s)
                strip = strip - q @ more
            waiting.append(strip[:, :next_width].copy())
            if sum(len(x) for x in waiting) >= fold.gather:
                settle()
            blocks = [strip[:, a:b] for a, b in zip(edges, edges[1:])]
            yield _rows([block_row] * len(after), [c for c, _, _ in after], [len(strip)] * len(after), lists_of_parts(blocks))
        if waiting:
            settle()
        if state is not None:
            yield _factor_rows(state)

    return cut_lineage(strips.mapInArrow(run, _STRIPS))


def _rows(block_row, block_col, n_rows, vals) -> pa.RecordBatch:
    n = len(block_row)
    ints = [pa.array(x, pa.int32()) for x in (block_row, block_col, n_rows)]
    nothing = [pa.nulls(n, pa.int32()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.list_(pa.float64()))]
    return pa.RecordBatch.from_arrays([*ints, vals, *nothing], ["block_row", "block_col", "n_rows", "vals", "part", "i", "vec"])


def _factor_rows(r: np.ndarray) -> pa.RecordBatch:
    n = len(r)
    nothing = [*[pa.nulls(n, pa.int32())] * 3, pa.nulls(n, pa.list_(pa.float64()))]
    part = pa.array(np.full(n, TaskContext.get().partitionId(), np.int32))
    own = [part, pa.array(np.arange(n, dtype=np.int32)), matrix_to_lists(r)]
    return pa.RecordBatch.from_arrays([*nothing, *own], ["block_row", "block_col", "n_rows", "vals", "part", "i", "vec"])


def _row_of_r(like: DataFrame, rows: np.ndarray, panels: list[Panel], block_row: int, start: int) -> DataFrame:
    """One row of blocks of R, from the diagonal on."""
    parts, at = [], 0
    for block_col, col_start, width in panels:
        parts.append((block_row, block_col, start, col_start, len(rows), width, rows[:, at : at + width].ravel()))
        at += width
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.float64())]
    names = [field.split()[0] for field in POSITIONED.split(", ")]
    table = pa.table([pa.array([part[c] for part in parts], kind) for c, kind in enumerate(kinds)], names=names)
    frame = like.sparkSession.createDataFrame(table)
    return frame if rows.size <= LOCAL_CELLS else cut_lineage(frame)
