import numpy as np
import pytest
from helpers import RUN_ERRORS, ridge, rows_of, solutions, wide_of
from pyspark.sql import functions as F

from stripgrid.layout import Packed, Wide
from stripgrid.plans.least_squares import (
    GradientDescent,
    NormalEquations,
    QrTree,
    System,
    relative_error,
    residual_norm,
    solution_array,
)
from stripgrid.plans.systems import accuracy_report, linear_systems
from stripgrid.sources.random import random_uniform, replayable_uniform

LAMBDAS = [0.0, 1e-4, 1e-6, 100.0]


@pytest.fixture(scope="module")
def data(spark):
    a, b = random_uniform(spark, 128, 16, 1, 4), random_uniform(spark, 128, 3, 2, 4)
    return a, b, a.to_local(), b.to_local()


@pytest.mark.parametrize("solver", [NormalEquations(), QrTree()])
def test_least_squares(spark, data, solver):
    a, b, a_local, b_local = data
    x = solution_array(solver.solve(System.align(a, b[:, 0:1])), 16)
    assert np.abs(x - np.linalg.lstsq(a_local, b_local[:, :1], rcond=None)[0]).max() < 1e-8


@pytest.mark.parametrize("solver", [NormalEquations(), QrTree()])
def test_many_penalties_and_targets(spark, data, solver):
    a, b, a_local, b_local = data
    found = solutions(solver.solve_many_l2(System.align(a, b), LAMBDAS))
    assert len(found) == 4 * 16 * 3
    for lam in LAMBDAS:
        expected = ridge(a_local, b_local, lam)
        x = np.array([[found[lam, j, k] for k in range(3)] for j in range(16)])
        assert np.abs(x - expected).max() < 1e-8
        assert np.abs(a_local.T @ (a_local @ x - b_local) + lam * x).max() < 1e-8


@pytest.mark.parametrize("solver", [NormalEquations(), QrTree()])
def test_own_residuals_per_penalty(spark, data, solver):
    a, b, a_local, b_local = data
    system = System.align(a, b)
    rng = np.random.default_rng(5)
    residuals = rng.normal(size=(128, 6))
    frame = rows_of(spark, residuals).df.withColumnRenamed("vec", "res")
    joined = System(system.base.join(frame, "row_id"), system.a, system.b, "row_id")
    rows = solver.solve_targets_l2(joined, Packed("res", 6), [0.5, 0.5]).collect()
    for target in (0, 1):
        expected = ridge(a_local, b_local - residuals[:, 3 * target : 3 * target + 3], 0.5)
        x = np.zeros((16, 3))
        for row in rows:
            if row.target == target:
                x[row.j, row.rhs] = row.x
        assert np.abs(x - expected).max() < 1e-8
    with pytest.raises(ValueError):
        solver.solve_targets_l2(joined, Packed("res", 6), [0.5])


def test_narrow_tables_solve_without_python_until_the_small_solve(spark):
    array = np.random.default_rng(6).normal(size=(300, 4))
    matrix = wide_of(spark, array)
    system = System(matrix.base, Wide(("v0", "v1", "v2")), Wide(("v3",)))
    solution = NormalEquations().solve_l2(system, 2.0)
    assert np.allclose(solution_array(solution, 3), ridge(array[:, :3], array[:, 3:], 2.0))
    plan = solution._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and plan.count("MapInArrow") == 1


def test_singular_systems_name_the_penalty(spark):
    array = np.ones((20, 3))
    system = System.align(rows_of(spark, array[:, :2]), rows_of(spark, array[:, 2:]))
    for solver in (NormalEquations(), QrTree()):
        with pytest.raises(RUN_ERRORS, match="lambda=0.0"):
            solver.solve(system).collect()
        assert solver.solve_l2(system, 1.0).count() == 2
    with pytest.raises(RUN_ERRORS, match="non-negative"):
        QrTree().solve_l2(system, -1.0).collect()


def test_rows_missing_on_one_side_are_an_error(spark, data):
    a, b, _, _ = data
    short = b.replace(b.base.filter("row_id < 100"), b.cells, n_rows=None)
    with pytest.raises(RUN_ERRORS, match="same rows"):
        NormalEquations().solve(System.align(a, short)).collect()


def descend(a, b, steps, step_size, lam, batch=None):
    w = np.zeros((a.shape[1], b.shape[1]))
    for t in range(1, steps + 1):
        rows = slice(None) if batch is None else batch(t)
        part, target = a[rows], b[rows]
        if len(part):
            rate = step_size / np.sqrt(t)
            w = w * (1 - rate * lam) - rate * part.T @ (part @ w - target) / len(part)
    return w


def test_gradient_descent(spark, data):
    a, b, a_local, b_local = data
    system = System.align(a, b[:, 0:1])
    solver = GradientDescent(steps=15, step_size=0.1)
    assert np.allclose(solution_array(solver.solve(system), 16), descend(a_local, b_local[:, :1], 15, 0.1, 0.0))
    found = solutions(solver.solve_many_l2(system, [0.0, 0.3]))
    expected = descend(a_local, b_local[:, :1], 15, 0.1, 0.3)
    assert np.allclose([found[0.3, j, 0] for j in range(16)], expected[:, 0])
    with pytest.raises(ValueError, match="single"):
        solver.solve(System.align(a, b))


def test_mini_batches_match_the_same_sample_drawn_by_hand(spark, data):
    a, b, a_local, b_local = data
    system = System.align(a, b[:, 0:1])
    solver = GradientDescent(steps=8, step_size=0.1, batch_fraction=0.3, seed=9)
    drawn = system.base.select(
        "row_id", *[(replayable_uniform(F.col("row_id"), F.lit(t), 9) < 0.3).alias(f"t{t}") for t in range(1, 9)]
    )
    sample = drawn.orderBy("row_id").toPandas()
    expected = descend(a_local, b_local[:, :1], 8, 0.1, 0.2, lambda t: sample[f"t{t}"].to_numpy())
    one_pass = solution_array(solver.solve_l2(system, 0.2), 16)
    by_steps = solution_array(solver.solve_by_steps(system, [0.2], [range(1)]), 16)
    assert np.allclose(one_pass, expected) and np.allclose(by_steps, expected)


def test_wide_residual_norm(spark):
    a, b = random_uniform(spark, 60, 40, 1), random_uniform(spark, 60, 8, 2)
    x = np.random.default_rng(3).normal(size=(40, 8))
    expected = np.linalg.norm(b.to_local() - a.to_local() @ x)
    assert residual_norm(System.align(a, b), x).head().value == pytest.approx(expected)


def test_residual_norm_and_relative_error(spark, data):
    a, b, a_local, b_local = data
    system = System.align(a, b)
    for x in (np.random.default_rng(1).normal(size=(16, 3)), np.zeros((16, 3))):
        assert residual_norm(system, x).head().value == pytest.approx(np.linalg.norm(b_local - a_local @ x))
    both = NormalEquations().solve_many_l2(system, [0.0, 5.0])
    first, second = both.filter("lam = 5.0"), both.filter("lam = 0.0")
    x, truth = solution_array(first, 16, 3), solution_array(second, 16, 3)
    expected = np.linalg.norm(x - truth) / np.linalg.norm(truth)
    assert relative_error(first, second).head().value == pytest.approx(expected)


def test_generated_systems(spark):
    left = random_uniform(spark, 400, 6, seed=2)
    systems = linear_systems(left, n_targets=2, conditions=[1.0, 1e4], thetas=[0.3])
    one = systems.known[1]
    system = systems.system(1)
    a, b = system.matrix().to_local(), system.rhs().to_local()
    assert np.linalg.cond(a) == pytest.approx(1e4**0.8)
    product = np.linalg.norm(a @ one.x, axis=0)
    assert np.allclose(product, one.product_norms)
    best = np.linalg.lstsq(a, b, rcond=None)[0]
    assert np.allclose(best, one.x * np.cos(0.3), atol=1e-8)
    assert np.allclose(np.linalg.norm(b - a @ best, axis=0), np.sin(0.3) * product)


def test_accuracy_report(spark):
    report = accuracy_report(linear_systems(random_uniform(spark, 1000, 11, seed=4))).toPandas()
    assert len(report) == 21
    tsqr = report[report.solver == "tsqr"].set_index("condition")
    normal = report[report.solver == "normal"].set_index("condition")
    assert (tsqr.relative_error[[1.0, 10.0, 1e3, 1e6]] < 1e-9).all()
    assert normal.relative_error[1e9] > 1e-3 > tsqr.relative_error[1e9]
    # The residual stays optimal long after the weights are lost.
    assert np.allclose(tsqr.residual / normal.residual, 1.0, rtol=1e-3)
    assert np.allclose(tsqr.cond_2[[10.0, 1e3, 1e6]], [10**0.9, 1e3**0.9, 1e6**0.9])
    assert (tsqr.cond_1 >= tsqr.cond_2 / 10).all()
