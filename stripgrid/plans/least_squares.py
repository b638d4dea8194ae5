"""Ridge least squares: minimise ||Ax - b||^2 + lambda ||x||^2 for several right-hand columns and penalties.

Each route makes one pass over the data that leaves a small square summary (a Gram matrix or an R factor), and
solves from that summary in one small task, so any number of penalties costs a single pass.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrow import matrix_of, matrix_to_lists
from ..functions.dense import gradient_steps, positive_r, ridge_from_gram, ridge_from_r, solve_named
from ..functions.monoids import monoid
from ..layout import LOCAL_WIDTH, NARROW, Cells, Packed, Wide
from ..operators.folding import ColumnReduce, Gram, RFactor, fold_rows
from ..operators.products import GENERATED_GRAM, GENERATED_PRODUCT, gram_rows, product_items, times_local
from ..row_matrix import RowMatrix, paired_rows
from ..sources.random import replayable_below, replayable_steps, replayable_uniform
from ..sources.tables import from_columns
from .tall_qr import collect_square, r_rows, squares_of

Expand = Callable[[np.ndarray], Iterable[tuple[int, np.ndarray]]]

SOLUTION_SCHEMA = "target int, lam double, j int, rhs int, x double"


class System:
    """A and b as columns of one table, so that solving needs no alignment join."""

    def __init__(self, base: DataFrame, a: Cells, b: Cells, key: str | None = None):
        self.base, self.a, self.b, self.key = base, a, b, key

    @classmethod
    def from_columns(
        cls, df: DataFrame, features: list[str], targets: list[str], row_id: str | None = None, nulls: str = "error"
    ) -> System:
        both = from_columns(df, features + targets, row_id, nulls)
        return cls(both.base, Wide(tuple(features)), Wide(tuple(targets)), both.key)

    @classmethod
    def align(cls, a: RowMatrix, b: RowMatrix) -> System:
        """Brought together on ``row_id``; a row missing on either side, or there twice, is an error."""
        return cls.align_many([a], b)

    @classmethod
    def align_many(cls, blocks: Sequence[RowMatrix], b: RowMatrix) -> System:
        """Column blocks of A and b, brought together on ``row_id`` in one shuffle."""
        names = ["b", *[f"a{p}" for p in range(len(blocks))]]
        joined = paired_rows([b, *blocks], names, "A and b must have the same rows, each once")
        vec = F.concat(*names[1:])
        width = sum(block.n_cols for block in blocks)
        base = joined.select("row_id", vec.alias("vec"), "b")
        return cls(base, Packed("vec", width), Packed("b", b.n_cols), "row_id")

    @property
    def n_cols(self) -> int:
        return self.a.width

    @property
    def n_targets(self) -> int:
        return self.b.width

    def matrix(self) -> RowMatrix:
        return RowMatrix(self.base, self.a, self.key)

    def rhs(self) -> RowMatrix:
        return RowMatrix(self.base, self.b, self.key)


class Solver:
    """Common shape of the routes: ``summarize`` is the pass over the data, ``local`` the small solve."""

    def summarize(self, frame: DataFrame, parts: list[Cells], key: Column | None) -> DataFrame:
        raise NotImplementedError

    def summary_width(self, n: int, rhs: int) -> int:
        return n + rhs

    def local(self, squares: dict[int, np.ndarray], n: int, lam: float) -> np.ndarray:
        raise NotImplementedError

    def summarize_expanded(self, matrix: RowMatrix, expand: Expand, width: int) -> DataFrame:
        """Summaries of several systems [A | b] of ``width`` columns, all derived from the rows of one matrix."""
        raise NotImplementedError

    def local_or_nan(self, square: np.ndarray, n: int) -> np.ndarray:
        """Unpenalised solve that reports a singular system as NaN."""
        try:
            return self.local({0: square}, n, 0.0)
        except ValueError:
            return np.full((n, square.shape[1] - (self.summary_width(n, 0))), np.nan)

    def change_basis(self, square: np.ndarray, basis: np.ndarray) -> np.ndarray:
        """Summary of the table whose columns are ``columns @ basis``."""
        raise NotImplementedError

    def check(self, rhs: int) -> None:
        """Raise when the route cannot take this many right-hand columns."""

    def solve(self, system: System) -> DataFrame:
        return self.solve_l2(system, 0.0)

    def solve_l2(self, system: System, lam: float) -> DataFrame:
        return self.solve_many_l2(system, [lam])

    def solve_many_l2(self, system: System, lams: Sequence[float]) -> DataFrame:
        """``(lam, j, rhs, x)`` for every penalty, from one pass."""
        self.check(system.n_targets)
        columns = [range(system.n_targets)] * len(lams)
        return self._solve(system, list(lams), columns).drop("target")

    def solve_targets_l2(self, system: System, residuals: Packed, lams: Sequence[float]) -> DataFrame:
        """``(target, lam, j, rhs, x)``: solve A x = b - residual_i with the i-th penalty, all from one pass.

        ``residuals`` is an array column of the system's table holding the residual rows one after another.
        """
        self.check(system.n_targets)
        k = system.n_targets
        if residuals.width != k * len(lams):
            raise ValueError(f"expected {k * len(lams)} residual columns, got {residuals.width}")
        keep = [F.col(system.key)] if system.key else []
        if residuals.width <= NARROW:
            b, offsets = system.b.items(), [_present(x) for x in residuals.items()]
            shifted = [(b[c % k] - offsets[c]).alias(f"_shifted{c}") for c in range(residuals.width)]
            cells: Cells = Wide(tuple(f"_shifted{c}" for c in range(residuals.width)))
        else:
            whole = F.when(F.size(residuals.array()) == residuals.width, residuals.array())
            whole = F.coalesce(whole, F.raise_error(F.lit("a residual row is NULL or has another length")).cast("array<double>"))
            pieces = [F.slice(whole, t * k + 1, k) for t in range(len(lams))]
            gaps = [F.zip_with(system.b.array(), piece, lambda x, y: x - _present(y)) for piece in pieces]
            shifted, cells = [F.concat(*gaps).alias("_shifted")], Packed("_shifted", residuals.width)
        moved = System(system.base.select(*keep, *system.a.columns(), *shifted), system.a, cells, system.key)
        return self._solve(moved, list(lams), [range(t * k, (t + 1) * k) for t in range(len(lams))])

    def _solve(self, system: System, lams: list[float], columns: list[range]) -> DataFrame:
        n, rhs = system.n_cols, system.n_targets
        key = F.col(system.key) if system.key else None
        summary = self.summarize(system.base, [system.a, system.b], key)
        width = self.summary_width(n, rhs)

        def solve(batches):
            squares = dict(squares_of(batches, width))
            if not squares:
                return
            for target, (lam, chosen) in enumerate(zip(lams, columns)):
                x = self.local(squares, n, lam)[:, list(chosen)]
                yield solution_batch(target, lam, x)

        return summary.coalesce(1).mapInArrow(solve, SOLUTION_SCHEMA)


def _present(residual: Column) -> Column:
    return F.coalesce(residual, F.raise_error(F.lit("a residual is NULL")).cast("double"))


def solution_batch(target: int, lam: float, x: np.ndarray) -> pa.RecordBatch:
    n, k = x.shape
    return pa.RecordBatch.from_pydict(
        {
            "target": pa.array(np.full(n * k, target, dtype=np.int32)),
            "lam": pa.array(np.full(n * k, lam, dtype=np.float64)),
            "j": pa.array(np.repeat(np.arange(n, dtype=np.int32), k)),
            "rhs": pa.array(np.tile(np.arange(k, dtype=np.int32), n)),
            "x": pa.array(x.ravel()),
        }
    )


class NormalEquations(Solver):
    """(A'A + lambda I) x = A'b. Fastest; loses accuracy with the square of the condition number."""

    def summarize(self, frame, parts, key):
        return gram_rows(frame, parts)

    def summarize_expanded(self, matrix, expand, width):
        return fold_rows(matrix.base, [matrix.cells], Gram(width), expand=expand)

    def local(self, squares, n, lam):
        gram = squares[0]
        return ridge_from_gram(gram[:n, :n], gram[:n, n:], lam)

    def local_or_nan(self, square, n):
        """For reports on accuracy: what the equations give even where ``solve`` refuses them as singular to precision."""
        try:
            return solve_named(square[:n, :n], square[:n, n:], 0.0)
        except ValueError:
            return np.full((n, square.shape[1] - n), np.nan)

    def change_basis(self, square, basis):
        return basis.T @ square @ basis


class QrTree(Solver):
    """R factor of [A | b] by a merge tree; the penalty stacks sqrt(lambda) I under it. Stable."""

    def summarize(self, frame, parts, key):
        return r_rows(frame, parts)

    def summarize_expanded(self, matrix, expand, width):
        return fold_rows(matrix.base, [matrix.cells], RFactor(width), expand=expand)

    def local(self, squares, n, lam):
        return ridge_from_r(squares[0], n, lam)

    def change_basis(self, square, basis):
        return positive_r(square @ basis)


class GradientDescent(Solver):
    """Mini-batch gradient descent with step size / sqrt(t), zero start and no intercept, one right-hand column.

    Minimises (1/2m)||Ax-b||^2 + (lambda/2)||x||^2 over each batch of m rows. The batch of step t is a sample drawn by
    the row key (which sampling requires), independent of the weights, so the moments of all batches come from one pass
    over the data, and anyone with the keys can draw the same batches (``sources.random.replayable_uniform``).
    """

    def __init__(self, steps: int = 100, step_size: float = 1.0, batch_fraction: float = 1.0, seed: int = 42):
        self.steps, self.step_size, self.batch_fraction, self.seed = steps, step_size, batch_fraction, seed

    def check(self, rhs: int) -> None:
        if rhs != 1:
            raise ValueError("gradient descent takes a single right-hand column")

    def summary_width(self, n: int, rhs: int) -> int:
        return n + rhs + 1

    def summarize(self, frame, parts, key):
        counted = frame.withColumn("_one", F.lit(1.0))
        parts = parts + [Wide(("_one",))]
        if self.batch_fraction >= 1.0:
            return gram_rows(counted, parts)
        # Each task adds up its rows per step before anything is shuffled.
        width = sum(part.width for part in parts)
        key, rule = _required(key), (self.steps, self.seed, self.batch_fraction)
        if width <= GENERATED_GRAM:
            return gram_rows(replayable_steps(counted, key, *rule, "_step"), parts, "_step")
        return fold_rows(counted.withColumn("_steps", replayable_below(key, *rule)), parts, Gram(width), "_steps")

    def summarize_expanded(self, matrix, expand, width):
        if self.batch_fraction < 1.0:
            raise ValueError("sampled batches of several systems are not summarised together")

        def counted(rows):
            for k, system in expand(rows):
                yield k, np.hstack([system, np.ones((len(system), 1))])

        return fold_rows(matrix.base, [matrix.cells], Gram(width + 1), expand=counted)

    def local(self, squares, n, lam):
        moments = squares.get if self.batch_fraction < 1.0 else lambda t: squares[0]
        return gradient_steps(moments, n, self.steps, self.step_size, lam)

    def change_basis(self, square, basis):
        return basis.T @ square @ basis

    def _solve(self, system, lams, columns):
        summaries = self.steps if self.batch_fraction < 1.0 else 1
        if summaries * self.summary_width(system.n_cols, system.n_targets) ** 2 <= LOCAL_WIDTH**2:
            return super()._solve(system, lams, columns)
        return self.solve_by_steps(system, lams, columns)

    def solve_by_steps(self, system: System, lams: list[float], columns: list[range]) -> DataFrame:
        """When the summaries would be too large: one gradient pass per step, only n numbers per task."""
        spark, n = system.base.sparkSession, system.n_cols
        sampled = self.batch_fraction < 1.0
        key = _required(F.col(system.key) if system.key else None) if sampled else None
        chosen = [c[0] for c in columns]
        weights = np.zeros((n, len(lams)))
        for t in range(1, self.steps + 1):
            batch = system.base
            if sampled:
                batch = batch.filter(replayable_uniform(key, F.lit(t), self.seed) < self.batch_fraction)
            total = collect_square(_gradient(batch, system, weights, chosen), n * len(lams) + 1)
            if len(total) == 0 or total[0, -1] == 0:
                continue
            rate = self.step_size / np.sqrt(t)
            slope = total[0, :-1].reshape(n, len(lams)) / total[0, -1]
            weights = weights * (1.0 - rate * np.array(lams)) - rate * slope
        batches = [solution_batch(t, lam, weights[:, t : t + 1]) for t, lam in enumerate(lams)]
        return spark.createDataFrame(pa.Table.from_batches(batches))


def _required(key: Column | None) -> Column:
    """Whether a row is in the batch of a step depends on its key alone, on every route; so there must be one."""
    if key is None:
        raise ValueError("sampled batches need a row key; build the system with row_id=...")
    return key


def _gradient(batch: DataFrame, system: System, weights: np.ndarray, chosen: list[int]) -> DataFrame:
    """One row: A'(A W - b) for the current weights, then the number of rows."""
    a, b = system.a, system.b
    width = weights.size + 1

    def slopes(batches):
        for part in batches:
            if part.num_rows:
                rows = matrix_of(part, [a])
                slope = rows.T @ (rows @ weights - matrix_of(part, [b])[:, chosen])
                line = np.append(slope.ravel(), part.num_rows)
                yield pa.RecordBatch.from_arrays([matrix_to_lists(line[None, :])], ["vec"])

    lines = batch.select(*a.columns(), *b.columns()).mapInArrow(slopes, "vec array<double>")
    return fold_rows(lines, [Packed("vec", width)], ColumnReduce(np.add))


# -- using a solution --------------------------------------------------------------------------------------


def solution_array(solution: DataFrame, n: int, k: int = 1) -> np.ndarray:
    """Bring an n x k solution ``(j, rhs, x)`` to the driver."""
    x = np.zeros((n, k))
    for row in solution.select("j", "rhs", "x").toLocalIterator():
        x[row.j, row.rhs] = row.x
    return x


def residual_norm(system: System, x: np.ndarray) -> DataFrame:
    """One row ``(value)`` = ||b - A x||_F, in one pass."""
    x = np.asarray(x, dtype=np.float64).reshape(system.n_cols, system.n_targets)
    if x.size <= GENERATED_PRODUCT:
        predicted = system.base
        gaps = [y - z for y, z in zip(system.b.items(), product_items(system.a, x))]
        squares = monoid("sum").of_items([gap * gap for gap in gaps])
    else:
        pairs = times_local(system.base, system.a, x, system.b.fields(), "_ax")
        predicted = pairs.select(F.explode_outer(F.arrays_zip(system.b.array().alias("b"), "_ax")).alias("pair"))
        gap = F.col("pair.b") - F.col("pair._ax")
        squares = gap * gap
    return predicted.agg(F.sqrt(F.coalesce(F.sum(squares), F.lit(0.0))).alias("value"))


def relative_error(solution: DataFrame, truth: DataFrame) -> DataFrame:
    """One row ``(value)`` = ||x - x*|| / ||x*||; both frames are ``(j, rhs, x)`` with the same entries, else an error."""
    true = truth.select("j", "rhs", F.col("x").alias("_true"))
    missing = F.raise_error(F.lit("the solution and the truth hold different entries")).cast("double")
    gap = F.coalesce(F.col("x") - F.col("_true"), missing)
    return solution.select("j", "rhs", "x").join(true, ["j", "rhs"], "full").agg(
        (F.sqrt(F.sum(gap * gap)) / F.sqrt(F.sum(F.col("_true") * F.col("_true")))).alias("value")
    )
