import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as spark_entry
from check_oracles import compare, duck
from helpers import RUN_ERRORS
from stripgrid.llm import negatives
from stripgrid.llm.negatives import Fields, hard_negatives

SCHEMA = "vec_id long, label int, embedding array<float>"


def mine(frame):
    """Every tenth row is an anchor."""
    return hard_negatives(frame, F.expr("vec_id % 10 = 0"), F.col("label"))


def brute(rows, positives=5, negatives=10):
    """Plain Python over (vec_id, label, vector): integers of any length, whole lists sorted."""
    whole = {k: (label, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for k, label, v in rows}
    out = set()
    for a, (label, v) in whole.items():
        if a % 10:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w)), k, other) for k, (other, w) in whole.items() if k != a)
        for minus, p, _ in [x for x in scored if x[2] == label][:positives]:
            fits = [x for x in scored if x[2] != label and 30 * -minus <= 100 * -x[0] <= 90 * -minus]
            out |= {(a, p, r + 1, k, -minus, -s) for r, (s, k, _) in enumerate(fits[:negatives])}
    return out


def found(frame):
    rows = [tuple(row) for row in frame.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def vectors(seed, n=300, d=5, labels=4, scale=1.0):
    draw = np.random.default_rng(seed)
    base = draw.normal(size=d) * 2
    return [(i, int(draw.integers(labels)), [float(x) for x in (base + draw.normal(size=d)) * scale]) for i in range(n)]


@pytest.mark.parametrize("seed,scale", [(1, 1.0), (2, 0.01), (3, 30_000.0)])
def test_all_pairs_brute_force(spark, seed, scale):
    """Small components tie often; large ones need Python integers (the last scale)."""
    rows = vectors(seed, scale=scale)
    frame = spark.createDataFrame(rows, SCHEMA).repartition(5)
    want = brute(rows)
    assert found(mine(frame)) == want and want


def test_slices_blocks_and_a_hot_label(spark, monkeypatch):
    """Several blocks of anchors, slices of a few rows, and a label with most rows, many of them equal."""
    monkeypatch.setattr(negatives, "ANCHORS", 7)
    rows = [(i, 0 if i % 3 else i % 5, [1.0, 0.5, float(i % 4)]) for i in range(400)]
    frame = spark.createDataFrame(rows, SCHEMA)
    assert found(mine(frame)) == brute(rows)


def test_rows_without_a_part(spark):
    rows = vectors(5, n=120)
    odd = [
        (1000, None, rows[0][2]),
        (1010, 1, None),
        (1020, 1, [1.0, None, 1.0, 1.0, 1.0]),
        (1030, 1, [float("nan")] * 5),
        (1040, 1, [float("inf")] * 5),
        (1050, 1, []),
        (1060, 1, [9.0] * 7),
        (None, 1, rows[0][2]),
        rows[0],
        rows[10],
    ]
    frame = spark.createDataFrame(rows + odd, SCHEMA)
    for name in ("key", "score", "rank", "anchor", "kind", "vector"):
        frame = frame.withColumn(name, F.lit("clash"))
    assert found(mine(frame)) == brute(rows)


def test_empty_tables(spark):
    frame = spark.createDataFrame([], SCHEMA)
    assert mine(frame).collect() == []
    lonely = spark.createDataFrame([(1, 1, [1.0, 2.0])], SCHEMA)
    assert mine(lonely).columns == negatives.OUT
    assert mine(lonely).collect() == []


def test_too_large_components_are_an_error(spark):
    frame = spark.createDataFrame([(0, 1, [1e30, 2.0]), (1, 1, [1.0, 2.0])], SCHEMA)
    with pytest.raises(RUN_ERRORS, match="beyond 32 bits"):
        mine(frame).collect()


@pytest.mark.parametrize("least,most", [(-148, 133), (0, 1), (-(2**20), 2**20), (-(2**31) + 1, 2**31 - 1), (5, 5)])
def test_packed_products_are_exact(least, most):
    draw = np.random.default_rng(7)
    a, x = (draw.integers(least, most, (n, 9), endpoint=True) for n in (4, 33))
    fields = Fields.of(9, least, most)
    want = [[sum(int(p) * int(q) for p, q in zip(u, v)) for v in x] for u in a]
    assert fields.scores(a, x).tolist() == want
    assert fields.count >= 2 or not fields.fast or fields.bits > 26


def test_query_matches_its_sql(spark, folder):
    name = "op11_hard_negatives"
    frame = spark_entry.queries()[name](spark, folder)
    assert compare(frame, duck(folder).execute(spark_entry.oracle_sql()[name])) == ""
