"""Block coordinate descent for ridge least squares over column blocks A = [A_1 ... A_p].

Two routes with the same iterates:

* compact: one pass leaves a summary of [A | b] (a Gram matrix or an R factor). Every block update needs the summary
  of [A_j | target], and the target is a linear combination of the columns, so it is a change of basis of that
  summary. The data is read once, however many iterations follow.
* streaming: for A wider than one task can hold as a square. The blocks lie side by side in one table, so a row can
  work out its own prediction from the current model; each block update is one narrow pass of the solver over that table,
  and nothing is shuffled or written between updates.

Blocks that arrive one by one (``solve_one_pass``) are joined to a table of predictions when they come.
"""

from __future__ import annotations

import random
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrow import matrix_of, matrix_to_lists
from ..functions.lineage import cut_lineage
from ..layout import LOCAL_WIDTH, Packed
from ..row_matrix import RowMatrix
from .least_squares import GradientDescent, Solver, System, solution_array, solution_batch
from .tall_qr import squares_of

BLOCK_SOLUTION_SCHEMA = "col_block int, target int, lam double, j int, rhs int, x double"
Callback = Callable[[list[np.ndarray], int], None]


class BlockCoordinateDescent:
    """``lams`` are solved side by side; block order is fixed, or reshuffled in every iteration from ``seed``."""

    def __init__(self, solver: Solver, iterations: int = 10, shuffle: bool = False, seed: int = 0):
        self.solver, self.iterations, self.shuffle, self.seed = solver, iterations, shuffle, seed

    def block_orders(self, blocks: int) -> list[list[int]]:
        rng = random.Random(self.seed)
        orders = []
        for _ in range(self.iterations):
            order = list(range(blocks))
            if self.shuffle:
                rng.shuffle(order)
            orders.append(order)
        return orders

    # -- entry points --------------------------------------------------------------------------------------

    def solve_columns(
        self, system: System, block_widths: Sequence[int], lams: Sequence[float], callback: Callback | None = None
    ) -> DataFrame:
        """Blocks are ranges of columns of one table. Returns ``(col_block, lam, j, rhs, x)``."""
        if sum(block_widths) != system.n_cols:
            raise ValueError("block widths must add up to the number of columns")
        if self._fits(system.n_cols, system.n_targets):
            return self._compact(system, list(block_widths), list(lams), callback)
        return self._streaming(system, list(block_widths), list(lams), callback)

    def solve(
        self,
        blocks: Sequence[RowMatrix],
        b: RowMatrix,
        lams: Sequence[float],
        callback: Callback | None = None,
        route: str = "auto",
    ) -> DataFrame:
        """Blocks are matrices with the same ``row_id``. Returns ``(col_block, lam, j, rhs, x)``.

        ``callback(models, block)`` runs on the driver after each block update, with one model per penalty.
        """
        widths = [block.n_cols for block in blocks]
        if route == "auto":
            route = "compact" if self._fits(sum(widths), b.n_cols) else "streaming"
        if route == "compact":
            return self._compact(System.align_many(blocks, b), widths, list(lams), callback)
        aligned = System.align_many(blocks, b)
        # The one shuffle of all blocks is written down, since every update reads its result.
        aligned = System(cut_lineage(aligned.base), aligned.a, aligned.b, aligned.key)
        return self._streaming(aligned, widths, list(lams), callback)

    def solve_one_pass(
        self, blocks: Iterable[RowMatrix], b: RowMatrix, lams: Sequence[float]
    ) -> Iterator[list[np.ndarray]]:
        """Each block once, starting from zero; blocks may be produced lazily. Yields one model per penalty."""
        state = _zero_state(b, len(lams))
        for block in blocks:
            zeros = [np.zeros((block.n_cols, b.n_cols)) for _ in lams]
            models, state = self._update(state, block, b.n_cols, zeros, list(lams))
            yield models

    def _fits(self, n: int, k: int) -> bool:
        sampled = isinstance(self.solver, GradientDescent) and self.solver.batch_fraction < 1.0
        return not sampled and self.solver.summary_width(n, k) <= LOCAL_WIDTH

    # -- compact route -------------------------------------------------------------------------------------

    def _compact(
        self, system: System, widths: list[int], lams: list[float], callback: Callback | None
    ) -> DataFrame:
        n, k, solver = system.n_cols, system.n_targets, self.solver
        solver.check(k)
        width = solver.summary_width(n, k)
        orders = self.block_orders(len(widths))
        key = F.col(system.key) if system.key else None
        summary = solver.summarize(system.base, [system.a, system.b], key).coalesce(1)

        def descend(batches):
            for _, square in squares_of(batches, width):
                models = descend_summary(solver, square, widths, k, lams, orders, None)
                yield from _model_batches(models, widths, lams)

        if callback is None:
            return summary.mapInArrow(descend, BLOCK_SOLUTION_SCHEMA).drop("target")
        # The callback runs on the driver, so the small summary does too.
        square = squares_of(summary.toArrow().to_batches(), width)[0][1]
        models = descend_summary(solver, square, widths, k, lams, orders, callback)
        return _models_frame(system.base, models, widths, lams)

    # -- streaming route -----------------------------------------------------------------------------------

    def _streaming(
        self, system: System, widths: list[int], lams: list[float], callback: Callback | None
    ) -> DataFrame:
        """Updates in place: the model is the only state, and it is on the driver (n x k numbers for each penalty)."""
        self.solver.check(system.n_targets)
        k, edges = system.n_targets, np.cumsum([0, *widths])
        models = np.zeros((system.n_cols, k * len(lams)))
        for order in self.block_orders(len(widths)):
            for p in order:
                own = slice(int(edges[p]), int(edges[p + 1]))
                inner, residuals = _block_system(system, own, models)
                for row in self.solver.solve_targets_l2(inner, residuals, lams).collect():
                    models[own.start + row.j, row.target * k + row.rhs] = row.x
                if callback is not None:
                    callback([x.copy() for x in np.split(models[own], len(lams), axis=1)], p)
        return _models_frame(system.base, np.split(models, len(lams), axis=1), widths, lams)

    def _update(
        self, state: DataFrame, block: RowMatrix, k: int, old: list[np.ndarray], lams: list[float]
    ) -> tuple[list[np.ndarray], DataFrame]:
        """One block: solve A_j x = b - (prediction - A_j x_old), then move the predictions along."""
        self.solver.check(k)
        part = block.base.select(F.col(block.require_key()).alias("row_id"), block.cells.array().alias("a"))
        joined = state.join(part, "row_id", "full_outer")
        complete = F.col("b").isNotNull() & F.col("a").isNotNull()
        problem = F.raise_error(F.lit("column blocks and b must have the same rows")).cast("array<double>")
        joined = joined.withColumn("a", F.when(complete, F.col("a")).otherwise(problem))
        joined.persist(StorageLevel.MEMORY_AND_DISK)
        a, pred = Packed("a", block.n_cols), Packed("pred", k * len(lams))
        targets = _shifted(joined, a, pred, np.hstack(old), sign=-1.0, keep=["row_id", "b", "a"])
        system = System(targets, a, Packed("b", k), "row_id")
        solution = self.solver.solve_targets_l2(system, pred, lams)
        rows = solution.collect()
        new = [np.zeros((block.n_cols, k)) for _ in lams]
        for row in rows:
            new[row.target][row.j, row.rhs] = row.x
        step = np.hstack([x - y for x, y in zip(new, old)])
        moved = cut_lineage(_shifted(joined, a, pred, step, sign=1.0, keep=["row_id", "b"]))
        joined.unpersist()
        return new, moved


def _block_system(system: System, own: slice, models: np.ndarray) -> tuple[System, Packed]:
    """The columns of one block, b, and as residuals what the other blocks predict; worked out row by row."""
    rest = models.copy()
    rest[own] = 0.0
    key = [system.key] if system.key else []
    cells = a_cells, b_cells = system.a, system.b

    def derive(batches):
        for batch in batches:
            a = matrix_of(batch, [a_cells])
            parts = a[:, own], matrix_of(batch, [b_cells]), a @ rest
            columns = [batch.column(name) for name in key] + [matrix_to_lists(part) for part in parts]
            yield pa.RecordBatch.from_arrays(columns, [*key, "a", "b", "pred"])

    schema = "".join(f"`{name}` bigint, " for name in key) + "a array<double>, b array<double>, pred array<double>"
    source = system.base.select(*key, *[column for part in cells for column in part.columns()])
    derived = source.mapInArrow(derive, schema)
    block = System(derived, Packed("a", own.stop - own.start), Packed("b", system.n_targets), system.key)
    return block, Packed("pred", models.shape[1])


def descend_summary(
    solver: Solver,
    square: np.ndarray,
    widths: list[int],
    k: int,
    lams: list[float],
    orders: list[list[int]],
    callback: Callback | None,
) -> list[np.ndarray]:
    """All block updates on the summary of [A | b | extra columns]; returns one n x k model per penalty."""
    n = sum(widths)
    edges = np.cumsum([0, *widths])
    total = square.shape[1]
    models = [np.zeros((n, k)) for _ in lams]
    for order in orders:
        for p in order:
            own = slice(edges[p], edges[p + 1])
            for i, lam in enumerate(lams):
                rest = models[i].copy()
                rest[own] = 0.0
                basis = np.zeros((total, widths[p] + total - n))
                basis[own, : widths[p]] = np.eye(widths[p])
                basis[n:, widths[p] :] = np.eye(total - n)
                basis[:n, widths[p] : widths[p] + k] = -rest
                small = solver.change_basis(square, basis)
                models[i][own] = solver.local({0: small}, widths[p], lam)
            if callback is not None:
                callback([model[own].copy() for model in models], p)
    return models


def _zero_state(b: RowMatrix, penalties: int) -> DataFrame:
    """``(row_id, b, pred)`` with zero predictions, one group of columns per penalty."""
    zeros = F.array_repeat(F.lit(0.0), b.n_cols * penalties)
    return b.base.select(F.col(b.require_key()).alias("row_id"), b.cells.array().alias("b"), zeros.alias("pred"))


def _shifted(frame: DataFrame, a: Packed, pred: Packed, x: np.ndarray, sign: float, keep: list[str]) -> DataFrame:
    """``keep`` columns and ``pred`` + sign * A x; ``x`` is one block wide and travels with the task."""
    x = sign * x
    if not x.any():
        return frame.select(*keep, "pred")

    def shift(batches):
        for batch in batches:
            moved = matrix_of(batch, [pred]) + matrix_of(batch, [a]) @ x
            yield pa.RecordBatch.from_arrays(
                [batch.column(name) for name in keep] + [matrix_to_lists(moved)], [*keep, "pred"]
            )

    schema = frame.select(*keep, "pred").schema
    return frame.select("row_id", "b", "a", "pred").mapInArrow(shift, schema)


def _model_batches(models: list[np.ndarray], widths: list[int], lams: list[float]):
    edges = np.cumsum([0, *widths])
    for p in range(len(widths)):
        for i, lam in enumerate(lams):
            batch = solution_batch(i, lam, models[i][edges[p] : edges[p + 1]])
            block = pa.array(np.full(batch.num_rows, p, dtype=np.int32))
            names = ["col_block", *batch.schema.names]
            yield pa.RecordBatch.from_arrays([block, *batch.columns], names)


def _models_frame(like: DataFrame, models: list[np.ndarray], widths: list[int], lams: list[float]) -> DataFrame:
    table = pa.Table.from_batches(list(_model_batches(models, widths, lams)))
    return like.sparkSession.createDataFrame(table).drop("target")
