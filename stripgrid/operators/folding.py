"""Whole-matrix folds: one small dense partial per task, then a merge tree over shuffles.

Every task streams its Arrow batches and keeps only an n x n (or shorter) partial, so a task's memory depends on
the number of columns and never on how many rows it reads. Rows are not shuffled; only partials are, and the
fan-in of the tree is bounded, whatever the number of tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrow import keyed_rows, lists_to_matrix, matrix_of
from ..functions.dense import positive_r
from ..functions.lineage import cut_lineage
from ..layout import LOCAL_WIDTH, Cells

PARTIAL_SCHEMA = "part int, key int, i int, vec array<double>"
FAN_IN = 32
NODE_BYTES = 64 * 2**20
# From this size on partials are written down and counted before they are merged.
LARGE_PARTIAL = 512 * 2**10


@dataclass(frozen=True)
class RFactor:
    """R of the rows seen so far; the R of stacked R factors is the R of all the rows."""

    width: int

    @property
    def cells(self) -> int:
        return self.width**2

    @property
    def gather(self) -> int:
        """Rows to gather before factoring, so that carrying the previous R along stays cheap."""
        return 2 * self.width

    def start(self, rows: np.ndarray) -> np.ndarray:
        return positive_r(rows)

    def add(self, state: np.ndarray, rows: np.ndarray) -> np.ndarray:
        return positive_r(np.vstack([state, rows]))

    def merge(self, state: np.ndarray | None, index: np.ndarray, rows: np.ndarray) -> np.ndarray:
        return positive_r(rows if state is None else np.vstack([state, rows]))


@dataclass(frozen=True)
class Gram:
    """Sum of outer products of the rows."""

    width: int
    gather = 1

    @property
    def cells(self) -> int:
        return self.width**2

    def start(self, rows: np.ndarray) -> np.ndarray:
        return rows.T @ rows

    def add(self, state: np.ndarray, rows: np.ndarray) -> np.ndarray:
        return state + rows.T @ rows

    def merge(self, state: np.ndarray | None, index: np.ndarray, rows: np.ndarray) -> np.ndarray:
        if state is None:
            state = np.zeros((self.width, self.width))
        np.add.at(state, index, rows)
        return state


@dataclass(frozen=True)
class ColumnReduce:
    """One row holding op over each column, for any associative and commutative NumPy ufunc."""

    op: np.ufunc
    cells: int = 1024
    gather = 1

    def start(self, rows: np.ndarray) -> np.ndarray:
        return self.op.reduce(rows, axis=0)[None, :]

    def add(self, state: np.ndarray, rows: np.ndarray) -> np.ndarray:
        return self.op(state, self.start(rows))

    def merge(self, state: np.ndarray | None, index: np.ndarray, rows: np.ndarray) -> np.ndarray:
        return self.start(rows) if state is None else self.add(state, rows)


def check_width(width: int, what: str) -> None:
    if width > LOCAL_WIDTH:
        raise ValueError(
            f"{what} holds a {width} x {width} result in one task, over the limit of {LOCAL_WIDTH} columns; "
            "use the block QR or block coordinate descent routes for wider matrices"
        )


def _split_by_key(batch: pa.RecordBatch, rows: np.ndarray, key: str | None):
    """(key, rows) pairs. ``key`` is an INT column, or an ARRAY<INT> column when a row counts for several keys."""
    if key is None:
        return [(0, rows)]
    column = batch.column(key)
    if pa.types.is_list(column.type):
        owners, keys = pc.list_parent_indices(column).to_numpy(), column.flatten().to_numpy()
        return [(int(k), rows[owners[keys == k]]) for k in np.unique(keys)]
    keys = column.to_numpy(zero_copy_only=False)
    return [(int(k), rows[keys == k]) for k in np.unique(keys)]


class _Folder:
    """Folds of one task, by key; short batches are gathered before they are folded in."""

    def __init__(self, fold):
        self.fold = fold
        self.states: dict[int, np.ndarray] = {}
        self.waiting: dict[int, list[np.ndarray]] = {}

    def take(self, key: int, rows: np.ndarray) -> None:
        waiting = self.waiting.setdefault(key, [])
        waiting.append(rows)
        if sum(len(piece) for piece in waiting) >= self.fold.gather:
            self.flush(key)

    def flush(self, key: int) -> None:
        pieces = self.waiting.pop(key)
        rows = pieces[0] if len(pieces) == 1 else np.vstack(pieces)
        state = self.states.get(key)
        self.states[key] = self.fold.start(rows) if state is None else self.fold.add(state, rows)

    def finish(self) -> dict[int, np.ndarray]:
        for key in list(self.waiting):
            self.flush(key)
        return self.states


def fold_rows(
    frame: DataFrame,
    parts: list[Cells],
    fold,
    key: str | None = None,
    expand: Callable[[np.ndarray], Iterable[tuple[int, np.ndarray]]] | None = None,
) -> DataFrame:
    """Fold all rows (per ``key``, with few distinct values) into one small matrix.

    ``expand`` turns a piece of the matrix into several keyed pieces derived from it, inside the task.
    Returns ``(key, i, vec)`` in a single partition.
    """
    width = sum(part.width for part in parts)
    columns = [column for part in parts for column in part.columns()]
    fields = frame.select(*([F.col(key)] if key else []), *columns)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folder = _Folder(fold)
        for batch in batches:
            if batch.num_rows:
                matrix = matrix_of(batch, parts)
                for k, rows in expand(matrix) if expand else _split_by_key(batch, matrix, key):
                    folder.take(k, rows)
        part = TaskContext.get().partitionId()
        for k, state in folder.finish().items():
            yield from keyed_rows({"part": part, "key": k}, state)

    return merge_tree(fields.mapInArrow(partial, PARTIAL_SCHEMA), fold, fold.cells)


def merge_tree(partials: DataFrame, fold, cells: int) -> DataFrame:
    """Merge partials level by level, each node from at most ``fan_in`` children; ``cells`` is the size of one partial.

    A node's children are partials with neighbouring numbers, so a task merges one node after another and keeps one state.
    Small partials have a large fan-in (64 MiB of them), and one level of nodes comes before the last merge whatever
    their number. Large partials are written down first; their number then says how many levels there are.
    """
    fan_in = max(FAN_IN, NODE_BYTES // (8 * max(1, cells)))
    levels = 1
    if 8 * cells > LARGE_PARTIAL:
        partials = cut_lineage(partials)
        last = partials.agg(F.max("part")).head()[0]
        levels = tree_levels(0 if last is None else last + 1, fan_in)
    for _ in range(levels):
        nodes = partials.select(F.expr(f"int(part div {fan_in})").alias("part"), "key", "i", "vec", F.col("part").alias("child"))
        # The order within a node fixes the order in which partials are added, hence the last bits of the result.
        dealt = nodes.repartition("part").sortWithinPartitions("part", "key", "child", "i").drop("child")
        partials = dealt.mapInArrow(_merger(fold), PARTIAL_SCHEMA)
    last = partials.repartition(1).sortWithinPartitions("key", "part", "i")
    return last.withColumn("part", F.lit(0)).mapInArrow(_merger(fold), PARTIAL_SCHEMA).drop("part")


def _merger(fold):
    """Merges rows that arrive sorted by node; each node is emitted when the next one begins."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, states = None, {}
        for batch in batches:
            nodes = batch.column("part").to_numpy()
            cuts = [0, *(np.nonzero(nodes[1:] != nodes[:-1])[0] + 1), len(nodes)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if nodes[a] != node:
                    yield from _emit(node, states)
                    node, states = nodes[a], {}
                piece = batch.slice(a, b - a)
                rows, index = lists_to_matrix(piece.column("vec")), piece.column("i").to_numpy()
                keys = piece.column("key").to_numpy()
                for k in np.unique(keys):
                    mine = keys == k
                    states[int(k)] = fold.merge(states.get(int(k)), index[mine], rows[mine])
        yield from _emit(node, states)

    return merge


def _emit(node: int | None, states: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    for k, state in states.items():
        yield from keyed_rows({"part": int(node), "key": k}, state)


def tree_levels(partials: int, fan_in: int) -> int:
    """Levels of nodes before the last merge, so that no merge has more than ``fan_in`` children."""
    levels = 0
    while partials > fan_in:
        partials = -(-partials // fan_in)
        levels += 1
    return levels
