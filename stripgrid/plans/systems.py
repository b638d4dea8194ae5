"""Least-squares systems with a chosen condition number and a known answer, and an accuracy report over them.

From any n x (c + 1) matrix: U and one extra direction q from its thin Q, A = U S V with singular values
kappa^(-j/c), and b = A x cos(theta) + q sin(theta) ||A x||. So theta is the angle between b and the range of A, the
solution is x cos(theta) and the residual norm is sin(theta) ||A x||, column by column.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrow import matrix_of, matrix_to_lists
from ..functions.dense import condition_one_norm, condition_two_norm
from ..functions.lineage import cut_lineage
from ..layout import Packed
from ..operators.folding import ColumnReduce, fold_rows
from ..row_matrix import RowMatrix
from .least_squares import GradientDescent, NormalEquations, QrTree, Solver, System
from .tall_qr import squares_of, thin_qr

# Condition numbers and angle of the standard accuracy sweep.
CONDITIONS = (1.0, 10.0, 1e3, 1e6, 1e9, 1e12, 1e15)
THETAS = (3.74e-6,)

SYSTEM_SCHEMA = "system_id int, row_id bigint, vec array<double>, b array<double>"


@dataclass(frozen=True)
class KnownSystem:
    """What is known about one generated system; ``middle`` is S V and ``x`` the generating weights."""

    system_id: int
    condition: float
    theta: float
    middle: np.ndarray
    x: np.ndarray

    @property
    def product_norms(self) -> np.ndarray:
        """||A x|| per right-hand column; equal to ||S V x|| because U has orthonormal columns."""
        return np.linalg.norm(self.middle @ self.x, axis=0)


    def build(self, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of A and b from rows of [U | q]."""
        a = u[:, :-1] @ self.middle
        return a, a @ self.x * np.cos(self.theta) + u[:, -1:] * np.sin(self.theta) * self.product_norms


@dataclass(frozen=True)
class SystemSet:
    """Systems that share one orthonormal [U | q]."""

    u: RowMatrix
    known: list[KnownSystem]

    @property
    def n_cols(self) -> int:
        return self.u.n_cols - 1

    @property
    def n_targets(self) -> int:
        return self.known[0].x.shape[1]

    def frame(self, system_ids: Sequence[int] | None = None) -> DataFrame:
        """``(system_id, row_id, vec, b)`` for some or all of the systems."""
        key, cells = self.u.require_key(), self.u.cells
        chosen = [one for one in self.known if system_ids is None or one.system_id in system_ids]

        def build(batches):
            for batch in batches:
                u = matrix_of(batch, [cells])
                for one in chosen:
                    a, b = one.build(u)
                    ids = pa.array(np.full(len(u), one.system_id, dtype=np.int32))
                    yield pa.RecordBatch.from_arrays(
                        [ids, batch.column(key), matrix_to_lists(a), matrix_to_lists(b)],
                        ["system_id", "row_id", "vec", "b"],
                    )

        return self.u.base.select(key, *cells.columns()).mapInArrow(build, SYSTEM_SCHEMA)

    def system(self, system_id: int) -> System:
        rows = self.frame([system_id]).drop("system_id")
        return System(rows, Packed("vec", self.n_cols), Packed("b", self.n_targets), "row_id")


def linear_systems(
    left: RowMatrix,
    n_targets: int = 1,
    conditions: Sequence[float] = CONDITIONS,
    thetas: Sequence[float] = THETAS,
    seed: int = 0,
) -> SystemSet:
    """One system per condition number and angle, all with the same U."""
    n = left.n_cols - 1
    rng = np.random.default_rng(seed)
    v, _ = np.linalg.qr(rng.random((n, n)))
    known = []
    for condition in conditions:
        for theta in thetas:
            sigma = float(condition) ** (-np.arange(n) / n)
            known.append(KnownSystem(len(known), condition, theta, sigma[:, None] * v, rng.random((n, n_targets))))
    u = thin_qr(left).q
    # Every system and every pass over it reads U: it is written down instead of generated and projected again.
    return SystemSet(u.replace(cut_lineage(u.base), u.cells), known)


def accuracy_report(systems: SystemSet, solvers: dict[str, Solver] | None = None) -> DataFrame:
    """One row per solver and system: residual norm, relative error and condition numbers.

    Each solver summarises all systems in one pass over U, without writing the systems out; one more pass takes the
    residuals.
    """
    solvers = solvers or {
        "tsqr": QrTree(),
        "normal": NormalEquations(),
        "sgd": GradientDescent(steps=10, step_size=0.1),
    }
    n, k, known = systems.n_cols, systems.n_targets, systems.known

    def expand(u):
        for one in known:
            yield one.system_id, np.hstack(one.build(u))

    factors = _collect_keyed(QrTree().summarize_expanded(systems.u, expand, n + k), n + k)
    solutions: dict[tuple[str, int], np.ndarray] = {}
    for name, solver in solvers.items():
        solver.check(k)
        squares = factors
        if not isinstance(solver, QrTree):
            squares = _collect_keyed(solver.summarize_expanded(systems.u, expand, n + k), solver.summary_width(n, k))
        for system_id, square in squares.items():
            solutions[name, system_id] = solver.local_or_nan(square, n)
    residuals = _residuals(systems, list(solvers), solutions)
    rows = []
    for name in solvers:
        for one in known:
            x, r = solutions[name, one.system_id], factors[one.system_id][:n, :n]
            error = float(np.linalg.norm(x - one.x) / np.linalg.norm(one.x))
            residual = residuals[name, one.system_id]
            conditions = condition_two_norm(r), condition_one_norm(r)
            rows.append((name, one.condition, one.theta, residual, error, *conditions))
    schema = (
        "solver string, condition double, theta double, residual double, relative_error double, cond_2 double, "
        "cond_1 double"
    )
    return systems.u.base.sparkSession.createDataFrame(rows, schema)


def _collect_keyed(summary: DataFrame, width: int) -> dict[int, np.ndarray]:
    return dict(squares_of(summary.select("key", "i", "vec").toArrow().to_batches(), width))


def _residuals(systems: SystemSet, names: list[str], solutions: dict) -> dict[tuple[str, int], float]:
    """||b - A x|| for every solver and system, from one pass over U."""
    known, copies = systems.known, len(names)
    stacked = {one.system_id: np.hstack([solutions[name, one.system_id] for name in names]) for one in known}

    def squares(u):
        for one in known:
            a, b = one.build(u)
            gaps = np.tile(b, copies) - a @ stacked[one.system_id]
            yield one.system_id, (gaps**2).reshape(len(u), copies, -1).sum(axis=2)

    sums = _collect_keyed(fold_rows(systems.u.base, [systems.u.cells], ColumnReduce(np.add), expand=squares), copies)
    return {
        (name, system_id): float(np.sqrt(total[0, i]))
        for system_id, total in sums.items()
        for i, name in enumerate(names)
    }
