import numpy as np
import pytest
from helpers import RUN_ERRORS, ridge, rows_of
from pyspark.sql import functions as F

from stripgrid.plans import block_descent
from stripgrid.plans.block_descent import BlockCoordinateDescent
from stripgrid.plans.least_squares import GradientDescent, NormalEquations, QrTree, System, residual_norm
from stripgrid.sources.random import random_uniform

SOLVERS = [NormalEquations(), QrTree()]


def sweep(a, b, widths, lam, orders):
    edges = np.cumsum([0, *widths])
    x = np.zeros((a.shape[1], b.shape[1]))
    for order in orders:
        for p in order:
            own = slice(edges[p], edges[p + 1])
            rest = x.copy()
            rest[own] = 0
            x[own] = ridge(a[:, own], b - a @ rest, lam)
    return x


def stack(frame, widths, k, lam):
    edges = np.cumsum([0, *widths])
    x = np.zeros((sum(widths), k))
    for row in frame.collect():
        if row.lam == lam:
            x[edges[row.col_block] + row.j, row.rhs] = row.x
    return x


@pytest.fixture(scope="module")
def blocks(spark):
    parts = [random_uniform(spark, 200, width, seed, 3).cache() for seed, width in ((1, 4), (2, 3), (3, 5))]
    b = random_uniform(spark, 200, 2, 9, 5).cache()
    return parts, b, np.hstack([part.to_local() for part in parts]), b.to_local()


@pytest.mark.parametrize("solver", SOLVERS)
@pytest.mark.parametrize("route", ["compact", "streaming"])
def test_both_routes_compute_the_same_iterates(spark, blocks, solver, route):
    parts, b, a_local, b_local = blocks
    descent = BlockCoordinateDescent(solver, iterations=2, shuffle=True, seed=4)
    found = descent.solve(parts, b, [0.0, 3.0], route=route)
    for lam in (0.0, 3.0):
        expected = sweep(a_local, b_local, [4, 3, 5], lam, descent.block_orders(3))
        assert np.abs(stack(found, [4, 3, 5], 2, lam) - expected).max() < 1e-9


@pytest.mark.parametrize("solver", SOLVERS)
def test_ten_iterations_come_close_to_the_solution(spark, solver):
    parts = [random_uniform(spark, 4096, 16, seed, 4) for seed in (1, 2)]
    b = random_uniform(spark, 4096, 1, 3, 4)
    found = stack(BlockCoordinateDescent(solver, 10).solve(parts, b, [0.0]), [16, 16], 1, 0.0)
    a_local = np.hstack([part.to_local() for part in parts])
    assert np.abs(found - ridge(a_local, b.to_local(), 0.0)).max() < 0.1


def test_columns_of_one_table(spark, blocks):
    parts, b, a_local, b_local = blocks
    system = System.align_many(parts, b)
    found = BlockCoordinateDescent(QrTree(), 3).solve_columns(system, [6, 6], [1.0])
    expected = sweep(a_local, b_local, [6, 6], 1.0, [[0, 1]] * 3)
    assert np.abs(stack(found, [6, 6], 2, 1.0) - expected).max() < 1e-9
    with pytest.raises(ValueError):
        BlockCoordinateDescent(QrTree()).solve_columns(system, [6, 5], [1.0])


def test_tables_too_wide_for_one_summary_are_streamed(spark, blocks, monkeypatch):
    parts, b, a_local, b_local = blocks
    system = System.align_many(parts, b)
    monkeypatch.setattr(block_descent, "LOCAL_WIDTH", 10)
    found = BlockCoordinateDescent(NormalEquations(), 1).solve_columns(system, [6, 6], [1.0])
    assert np.abs(stack(found, [6, 6], 2, 1.0) - sweep(a_local, b_local, [6, 6], 1.0, [[0, 1]])).max() < 1e-9


def test_gradient_descent_inside_blocks(spark, blocks):
    parts, b, a_local, b_local = blocks
    descent = BlockCoordinateDescent(GradientDescent(5, 0.2), 1)
    one = b[:, 0:1]
    compact = stack(descent.solve(parts[:2], one, [0.1]), [4, 3], 1, 0.1)
    streaming = stack(descent.solve(parts[:2], one, [0.1], route="streaming"), [4, 3], 1, 0.1)
    assert np.abs(compact - streaming).max() < 1e-12
    with pytest.raises(ValueError, match="single"):
        descent.solve(parts, b, [0.1])


@pytest.mark.parametrize("route", ["compact", "streaming"])
def test_callback_sees_every_block(spark, blocks, route):
    parts, b, _, _ = blocks
    seen = []
    descent = BlockCoordinateDescent(NormalEquations(), 2)
    found = descent.solve(parts[:2], b, [0.0, 1.0], lambda models, p: seen.append((p, models)), route=route)
    assert [p for p, _ in seen] == [0, 1, 0, 1]
    last = seen[-1][1]
    assert len(last) == 2 and last[0].shape == (3, 2)
    assert np.allclose(stack(found, [4, 3], 2, 1.0)[4:], last[1])


def test_one_pass_never_makes_the_residual_larger(spark):
    blocks = [random_uniform(spark, 1024, 8, seed, 4) for seed in range(4)]
    b = random_uniform(spark, 1024, 1, 99, 4)
    local, rest = [block.to_local() for block in blocks], b.to_local()
    norms = [np.linalg.norm(rest)]
    for p, models in enumerate(BlockCoordinateDescent(NormalEquations()).solve_one_pass(iter(blocks), b, [0.0])):
        assert np.allclose(models[0], ridge(local[p], rest, 0.0))
        rest = rest - local[p] @ models[0]
        norms.append(np.linalg.norm(rest))
    assert len(norms) == 5 and all(after <= before for before, after in zip(norms, norms[1:]))
    system = System.align(blocks[0], b)
    assert residual_norm(system, np.zeros((8, 1))).head().value == pytest.approx(norms[0])


def test_blocks_must_have_the_rows_of_b(spark, blocks):
    _, b, _, _ = blocks
    short = rows_of(spark, np.ones((150, 2)))
    with pytest.raises(RUN_ERRORS, match="same rows"):
        BlockCoordinateDescent(NormalEquations(), 1).solve([short], b, [1.0], route="streaming")


def _plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_an_update_moves_no_rows(spark):
    """The plan of an update holds only the merge tree of the solver: its exchanges come after a partial per task."""
    from stripgrid.plans.block_descent import _block_system

    a, b = random_uniform(spark, 200, 6, 1), random_uniform(spark, 200, 2, 2)
    system = System.align(a, b)
    system = System(system.base.cache(), system.a, system.b, system.key)
    inner, residuals = _block_system(system, slice(2, 4), np.ones((6, 4)))
    assert "Exchange" not in _plan(inner.base).split("InMemoryRelation")[0]
    plan = _plan(NormalEquations().solve_targets_l2(inner, residuals, [0.0, 1.0])).split("InMemoryRelation")[0]
    below = plan[plan.rindex("Exchange") :]
    assert "MapInArrow" in below or "HashAggregate" in below
    local = a.to_local()
    got = {r.row_id: (r.a, r.pred) for r in inner.base.collect()}
    rest = np.ones((6, 4))
    rest[2:4] = 0
    assert all(np.allclose(got[i][0], local[i, 2:4]) and np.allclose(got[i][1], local[i] @ rest) for i in range(200))
    system.base.unpersist()


@pytest.mark.parametrize("solver", [NormalEquations(), QrTree()])
def test_streaming_without_a_key_and_with_many_penalties(spark, solver, monkeypatch):
    """Columns of one keyless table, forced to the streaming route; the same iterates as the compact one."""
    frame = random_uniform(spark, 150, 7, 3).base
    system = System.from_columns(frame.select(*[F.col("vec")[j].alias(f"x{j}") for j in range(7)]), [f"x{j}" for j in range(5)], ["x5", "x6"])
    descent = BlockCoordinateDescent(solver, iterations=3, shuffle=True, seed=4)
    compact = {tuple(r)[:4]: r.x for r in descent.solve_columns(system, [2, 1, 2], [0.1, 5.0]).collect()}
    monkeypatch.setattr("stripgrid.plans.block_descent.LOCAL_WIDTH", 0)
    seen = []
    streaming = descent.solve_columns(system, [2, 1, 2], [0.1, 5.0], lambda models, p: seen.append((p, models[0].shape)))
    streaming = {tuple(r)[:4]: r.x for r in streaming.collect()}
    assert streaming.keys() == compact.keys() and all(abs(streaming[k] - compact[k]) < 1e-9 for k in compact)
    assert len(seen) == 9 and {shape for _, shape in seen} == {(2, 2), (1, 2)}
