import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import RUN_ERRORS
from stripgrid.functions.dense import numerical_rank
from stripgrid.layout import Packed
from stripgrid.plans.least_squares import GradientDescent, NormalEquations, QrTree, System, relative_error
from stripgrid.sources.grids import to_grid
from stripgrid.sources.random import replayable_below, replayable_steps, replayable_uniform
from stripgrid.sources.tables import from_arrays


def test_null_from_an_element_map_is_an_error(spark):
    matrix = from_arrays(spark.createDataFrame([(0, [1.0, 3.0])], "id long, v array<double>"), "v", row_id="id")
    with pytest.raises(Exception, match="gave NULL"):
        matrix.map_elements(lambda x: F.when(x > 2, x)).col_sums().collect()


@pytest.mark.parametrize("grid", [1, 2, 4])
def test_block_row_min_with_nan_does_not_depend_on_the_grid(spark, grid):
    rows = spark.createDataFrame([(0, [float("nan"), 1.0, 2.0, 3.0])], "id long, v array<double>")
    blocks = to_grid(from_arrays(rows, "v", row_id="id"), 1, grid)
    assert [x["value"] for x in blocks.reduce_row_elements("min").to_long().collect()] == [1.0]


def test_relative_error_needs_the_same_entries(spark):
    truth = spark.createDataFrame([(0, 0, 1.0), (1, 0, 2.0)], "j int, rhs int, x double")
    assert relative_error(truth, truth).first()["value"] == 0.0
    with pytest.raises(Exception, match="different entries"):
        relative_error(truth.where("j = 0"), truth).collect()


@pytest.mark.parametrize("solver", [NormalEquations(), QrTree()])
def test_null_residuals_are_an_error(spark, solver):
    rows = [(float(i), float(i * i % 7), 1.0 * i, [0.5, None] if i == 3 else [0.5, 0.1]) for i in range(20)]
    frame = spark.createDataFrame(rows, "a double, c double, b double, gaps array<double>")
    system = System.from_columns(frame, ["a", "c"], ["b"])
    with pytest.raises(Exception, match="residual"):
        solver.solve_targets_l2(System(frame, system.a, system.b, None), Packed("gaps", 2), [0.0, 1.0]).collect()


def test_repeated_keys_are_an_error(spark):
    """Ids (0, 0, 1) against themselves must not give five rows."""
    frame = spark.createDataFrame([(0, [1.0]), (0, [2.0]), (1, [3.0])], "row_id bigint, v array<double>")
    twice = from_arrays(frame, "v", "row_id", n_cols=1)
    once = from_arrays(frame.dropDuplicates(["row_id"]), "v", "row_id", n_cols=1)
    for left, right in ((twice, twice), (once, twice), (twice, once)):
        with pytest.raises(RUN_ERRORS, match="unequal size"):
            (left + right).base.collect()
        for blocks in ([left], [left, left]):
            with pytest.raises(RUN_ERRORS, match="same rows, each once"):
                System.align_many(blocks, right).base.collect()


@pytest.mark.parametrize("factor", [0.3, 3.0, -1e-7, 1e9])
def test_dependent_columns_are_an_error_of_the_normal_equations(spark, factor):
    a = np.random.default_rng(1).normal(size=400)
    rows = [(float(x), float(x) * factor, float(x) + 1.0) for x in a]
    system = System.from_columns(spark.createDataFrame(rows, "a double, b double, y double"), ["a", "b"], ["y"])
    for solver in (NormalEquations(), QrTree()):
        with pytest.raises(RUN_ERRORS, match="singular"):
            solver.solve(system).collect()
    assert len(NormalEquations().solve_l2(system, 1.0 * factor**2).collect()) == 2


def test_numerical_rank():
    draw = np.random.default_rng(3)
    for n, rank in ((1, 1), (5, 5), (6, 4), (40, 39)):
        array = draw.normal(size=(500, rank)) @ draw.normal(size=(rank, n)) * 10.0 ** draw.integers(-6, 6, n)
        assert numerical_rank(array.T @ array) == rank
    u, v = (np.linalg.qr(draw.normal(size=(m, 10)))[0] for m in (300, 10))
    array = u * 1e5 ** (-np.arange(10) / 9) @ v.T
    assert numerical_rank(array.T @ array) == 10  # a condition number of 1e5 is within reach
    assert numerical_rank(np.zeros((0, 0))) == 0 and numerical_rank(np.zeros((2, 2))) == 0


def test_sampling_needs_a_key(spark):
    system = System.from_columns(spark.createDataFrame([(1.0, 2.0)], "a double, y double"), ["a"], ["y"])
    for solver in (GradientDescent(3, 0.1, batch_fraction=0.5),):
        with pytest.raises(ValueError, match="row key"):
            solver.solve(system)
        with pytest.raises(ValueError, match="row key"):
            solver.solve_by_steps(system, [0.0], [range(1)])


def test_replayable_uniform_is_uniform_and_steps_are_unrelated(spark):
    keys = spark.range(-50, 40_000).withColumn("far", F.col("id") * 2**40 + 7)
    for column in ("id", "far"):
        drawn = keys.select(*[replayable_uniform(F.col(column), F.lit(t), 42).alias(f"t{t}") for t in (1, 2, 3, 17)]).toPandas()
        assert drawn.min().min() >= 0 and drawn.max().max() < 1
        assert np.abs(drawn.mean() - 0.5).max() < 0.01 and np.abs(drawn.std() - 12**-0.5).max() < 0.005
        related = np.corrcoef(drawn.T.to_numpy()) - np.eye(4)
        assert np.abs(related).max() < 0.02
        assert np.abs(np.corrcoef(drawn["t1"][1:], drawn["t1"][:-1])[0, 1]) < 0.02


def test_all_forms_of_the_sampling_rule_agree(spark):
    keys = spark.range(-20, 200).withColumn("id", F.col("id") * 987_654_321)
    arrays = keys.select("id", F.explode(replayable_below(F.col("id"), 9, 42, 0.3)).alias("t"))
    rows = replayable_steps(keys, F.col("id"), 9, 42, 0.3, "t").select("id", "t")
    single = keys.crossJoin(spark.range(1, 10).selectExpr("cast(id as int) t")).where(replayable_uniform(F.col("id"), F.col("t"), 42) < 0.3)
    found = [{tuple(r) for r in frame.collect()} for frame in (arrays, rows, single)]
    assert found[0] == found[1] == found[2] and 300 < len(found[0]) < 900
