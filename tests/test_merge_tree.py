import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import rows_of
from stripgrid.functions.arrow import keyed_rows
from stripgrid.layout import Packed
from stripgrid.operators import folding
from stripgrid.operators.folding import PARTIAL_SCHEMA, Gram, RFactor, fold_rows, merge_tree
from stripgrid.plans.tall_qr import collect_square


def partials_of(spark, count, width):
    """One partial per number, far more than there are tasks."""

    def make(batches):
        for batch in batches:
            for part in batch.column("id").to_pylist():
                square = np.random.default_rng(part).normal(size=(width, width))
                yield from keyed_rows({"part": part, "key": part % 2}, square)

    return spark.range(0, count, 1, 4).mapInArrow(make, PARTIAL_SCHEMA)


@pytest.mark.parametrize("large", [False, True])
def test_3000_partials(spark, monkeypatch, large):
    """Both routes give the same sums; the large one counts its partials and plans two levels before the last."""
    if large:
        monkeypatch.setattr(folding, "LARGE_PARTIAL", 0)
        monkeypatch.setattr(folding, "NODE_BYTES", 0)
    frame = merge_tree(partials_of(spark, 3000, 3), Gram(3), 9)
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(part") == (2 if large else 1) and plan.count("SinglePartition") == 1
    for key in (0, 1):
        want = sum(np.random.default_rng(p).normal(size=(3, 3)) for p in range(key, 3000, 2))
        assert np.allclose(collect_square(frame.where(F.col("key") == key), 3), want)


def test_the_scan_keeps_its_tasks(spark):
    """3000 splits of a wide table: no task is asked to read several of them, and the factor is right."""
    array = np.random.default_rng(1).normal(size=(600, 300))
    matrix = rows_of(spark, array, 300)
    frame = fold_rows(matrix.base, [Packed("vec", 300)], Gram(300))
    plan = frame._jdf.queryExecution().optimizedPlan().toString()
    assert "Repartition 32, false" not in plan and "coalesce" not in plan.lower()
    assert np.allclose(collect_square(frame, 300), array.T @ array)


def test_r_factor_through_many_levels(spark, monkeypatch):
    monkeypatch.setattr(folding, "LARGE_PARTIAL", 0)
    monkeypatch.setattr(folding, "NODE_BYTES", 0)
    monkeypatch.setattr(folding, "FAN_IN", 2)
    array = np.random.default_rng(2).normal(size=(200, 5))
    matrix = rows_of(spark, array, 23)
    found = collect_square(fold_rows(matrix.base, [matrix.cells], RFactor(5)), 5)
    r = np.linalg.qr(array)[1]
    assert np.allclose(found, r * np.sign(np.diagonal(r))[:, None])


def test_no_rows(spark):
    matrix = rows_of(spark, np.ones((3, 2)))
    assert fold_rows(matrix.base.where("false"), [matrix.cells], Gram(2)).count() == 0
