import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from stripgrid.llm.mixing import mix, round_parts, take, targets
from stripgrid.llm.queries import WORDS, op9_mixing


def fill(sizes):
    """Targets by sharing out again and again."""
    names = sorted((x for x in sizes if x is not None), key=lambda x: x.encode()) + [x for x in sizes if x is None]
    weight = {x: (5, 2, 1)[i % 3] for i, x in enumerate(names)}
    out, left, active = {x: 0.0 for x in names}, 1.5 * sum(sizes.values()), set(names)
    while active and left > 1e-9:
        whole = sum(weight[x] for x in active)
        share = {x: left * weight[x] / whole for x in active}
        left = 0.0
        for x, extra in share.items():
            out[x] += extra
            if out[x] >= 2 * sizes[x]:
                left += out[x] - 2 * sizes[x]
                out[x] = 2.0 * sizes[x]
                active.discard(x)
    return out


def test_targets(spark):
    for sizes in ({"a": 100, "b": 900, "c": 5, None: 40}, {"x": 7}, {"a": 0, "b": 10}, {chr(97 + i): 10 ** (i % 4) for i in range(9)}):
        rows = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        found = {x["source"]: x["target"] for x in targets(rows).collect()}
        for name, value in fill(sizes).items():
            assert found[name] == pytest.approx(value, rel=1e-9, abs=1e-6)


def test_query(spark, folder, documents):
    rows = {x["doc_id"]: x for x in documents.collect()}
    found = op9_mixing(spark, folder).collect()
    assert sorted(x["doc_id"] for x in found) == sorted(rows)
    taken, sizes, goal, largest = defaultdict(int), defaultdict(int), {}, defaultdict(int)
    for x in found:
        row = rows[x["doc_id"]]
        assert x["size"] == len(re.findall(WORDS, row["text"] or "")) and x["taken"] <= 2 * x["size"]
        assert x["size"] == 0 or x["taken"] % x["size"] == 0
        sizes[row["source"]] += x["size"]
        taken[row["source"]] += x["taken"]
        largest[row["source"]] = max(largest[row["source"]], x["size"])
        goal[row["source"]] = x["target"]
    for name, value in fill(sizes).items():
        assert goal[name] == pytest.approx(value, rel=1e-9)
        assert abs(taken[name] - value) <= largest[name]
    again = op9_mixing(spark, folder).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, found))


def test_parts_keep_their_expectation(spark):
    rows = spark.range(2000).selectExpr("'s' as source", "id as unit", "1 + id % 50 as size", "(id % 10) / 10D as part").where("part > 0")
    counts = defaultdict(int)
    for seed in range(12):
        for x in round_parts(rows, seed, group=64).collect():
            counts[x["unit"] % 10] += x["copies"]
    for tenth in range(1, 10):
        assert counts[tenth] / (12 * 200) == pytest.approx(tenth / 10, abs=0.05)
    decided = round_parts(rows, 1, group=64).join(rows, "unit")
    sums = decided.agg(F.sum(F.expr("copies * size")), F.sum(F.expr("part * size"))).first()
    assert abs(sums[0] - sums[1]) <= 50


def test_odd_rows(odd_documents, no_documents):
    mixed = mix(odd_documents, F.regexp_count("text", F.lit(WORDS)))
    rows = mixed.collect()
    assert len(rows) == odd_documents.count() and all(0 <= x["copies"] <= 2 for x in rows)
    twins = [x["copies"] for x in rows if x["doc_id"] == 1]
    assert twins[0] == twins[1]
    assert take(mixed, odd_documents.columns).columns == odd_documents.columns
    assert take(mixed, odd_documents.columns).count() == sum(x["copies"] for x in rows)
    assert mix(no_documents, F.lit(1)).count() == 0
