import numpy as np
import pytest

from stripgrid.llm.neighbours import CentreGraph, balanced_centres, nearest, unit_rows
from stripgrid.llm.queries import op8_nearest


def exact(queries, rows, k):
    out = {}
    for name, q in queries:
        scored = [(-float(np.dot(q, v) / (np.linalg.norm(q) * np.linalg.norm(v))), key) for key, v in rows if key != name]
        out[name] = sorted((round(s, 12), key) for s, key in scored)[:k]
    return out


@pytest.mark.parametrize("where", ["sf0.001", "sf0.1"])
def test_recall(spark, where):
    folder = f"/root/testdata/{where}"
    rows = [(x["vec_id"], np.array(x["embedding"], float)) for x in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    wanted = exact([x for x in rows if x[0] % 50 == 0], rows, 5)
    found = {}
    for x in op8_nearest(spark, folder).orderBy("query_id", "rank").collect():
        found.setdefault(x["query_id"], []).append((-x["score"], x["vec_id"]))
    assert set(found) == set(wanted)
    by_key = dict(rows)
    hits = 0
    for name, pairs in found.items():
        q = by_key[name]
        assert pairs == sorted(pairs) and len(pairs) == 5
        for score, key in pairs:
            assert abs(-score - np.dot(q, by_key[key]) / np.linalg.norm(q) / np.linalg.norm(by_key[key])) < 1e-12
        hits += len({k for _, k in pairs} & {k for _, k in wanted[name]})
    assert hits / (5 * len(wanted)) >= 0.95


def test_graph_finds_what_a_scan_finds():
    centres = unit_rows(np.random.default_rng(0).normal(size=(600, 16)))
    graph, sizes = CentreGraph(centres), np.ones(600, np.int64)
    hit = total = 0
    for q in unit_rows(np.random.default_rng(1).normal(size=(50, 16))):
        far = np.sqrt(np.maximum(0, 2 - 2 * centres @ q))
        wanted = set(np.nonzero(far <= 1.25 * far.min())[0].tolist())
        hit, total = hit + len(wanted & set(graph.search(q, 1.25, 1, sizes))), total + len(wanted)
    assert hit / total > 0.97


def test_lists_are_balanced():
    x = np.random.default_rng(0).normal(size=(4000, 8)) + np.array([4.0] + [0] * 7)
    centres = balanced_centres(x, 40)
    sizes = np.bincount((unit_rows(x) @ centres.T).argmax(1), minlength=len(centres))
    assert sizes.max() < 6 * sizes.mean()


def test_odd_vectors(spark):
    rows = [(0, [1.0, 0.0]), (50, [1.0, 0.0]), (50, [1.0, 0.0]), (1, None), (2, [0.0, 0.0]), (3, [float("nan"), 1.0]), (4, [None, 1.0]),
            (5, [1.0]), (None, [1.0, 1.0]), (7, [0.0, 2.0]), (8, [float("inf"), 0.0]), (6, [3.0, 0.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as list", "2 as key", "3 as score")
    found = [tuple(x) for x in nearest(frame.where("vec_id % 50 = 0"), frame).orderBy("query_id", "rank").collect()]
    assert found == [(0, 1, 6, 1.0), (0, 2, 50, 1.0), (0, 3, 7, 0.0), (50, 1, 0, 1.0), (50, 2, 6, 1.0), (50, 3, 7, 0.0)]
    assert nearest(frame.where("false"), frame).count() == 0
    assert nearest(frame, frame.where("false")).count() == 0


def test_one_vector_fills_a_third(spark):
    draw = np.random.default_rng(5)
    rows = [(i, [1.0, 0.5, 0.25] if i % 3 == 0 else draw.normal(size=3).tolist()) for i in range(3000)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = nearest(frame.where("vec_id = 1500"), frame).orderBy("rank").collect()
    assert [x["vec_id"] for x in found] == [0, 3, 6, 9, 12]


def test_repeats_of_a_near_row_leave_room_for_other_keys(spark):
    """One key fills a third of the rows, with one vector many times and with many vectors."""
    draw = np.random.default_rng(7)
    rows = [(i, [1.0, 0.01 * i, 0.0]) for i in range(1, 9)]
    rows += [(100, [1.0, 0.001, 0.0])] * 400 + [(101, [1.0, 1e-4 * x, 0.0]) for x in draw.random(400).tolist()]
    rows += [(200 + i, draw.normal(size=3).tolist()) for i in range(800)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    queries = spark.createDataFrame([(0, [1.0, 0.0, 0.0])], "vec_id long, embedding array<double>")
    best = {}
    for key, v in rows:
        best[key] = max(best.get(key, -2.0), v[0] / float(np.linalg.norm(v)))
    wanted = sorted(best, key=lambda x: (-best[x], x))[:5]
    assert [x["vec_id"] for x in nearest(queries, frame).orderBy("rank").collect()] == wanted
