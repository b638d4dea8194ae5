import hashlib
import random

from check_oracles import compare, duck

from stripgrid.llm.dedup import CuckooFilter, DigestIndex, dedup
from stripgrid.llm.queries import ORACLES, op7_exact_dedup


def digest(x):
    return hashlib.sha256(str(x).encode()).hexdigest()


def test_filter_inserts_deletes_and_grows():
    draw, index, live = random.Random(3), CuckooFilter(), {}
    for turn in range(6000):
        x = digest(draw.randrange(3000))
        if x in live and draw.random() < 0.4:
            assert index.delete(x)
            del live[x]
        elif not index.find(x):
            assert x not in live
            index.insert(x, (turn,))
            live[x] = (turn,)
    assert index.live == live and all(index.find(x) for x in live) and index.resized > 3
    assert not any(index.find(digest(f"other {i}")) for i in range(3000))
    assert not index.delete(digest("never"))


def test_index_over_several_batches(spark):
    columns = "digest string, copies long, points long, no_key boolean, key long, row long"
    batch = lambda rows: spark.createDataFrame(rows, columns)
    index = DigestIndex.empty(spark, 60_000)
    assert index.shards == 3
    index = index.insert(batch([(digest(i), 1, 5, False, i, i) for i in range(50)] + [(digest(7), 2, 9, False, 70, 70)]))
    index = index.delete(batch([(digest(i), 0, 0, False, 0, 0) for i in range(10, 60)]))
    index = index.insert(batch([(digest(3), 4, 5, False, 2, 100), (digest(20), 1, 1, True, None, 101)]))
    rows = {x["digest"]: (x["copies"], x["key"]) for x in index.rows.collect()}
    assert rows == {digest(i): (1, i) for i in range(10)} | {digest(7): (3, 70), digest(3): (5, 2), digest(20): (1, None)}


def test_query_matches_its_sql(spark, folder):
    assert compare(op7_exact_dedup(spark, folder), duck(folder).execute(ORACLES["op7_exact_dedup"])) == ""


def test_white_space_and_ties(spark):
    rows = [(4, "a b"), (2, "ab"), (3, " ab"), (9, "ab "), (1, "b")]
    found = {x["doc_id"]: x for x in dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [found[i]["keep_key"] for i in (4, 2, 3, 9, 1)] == [3, 3, 3, 9, 1]
    assert [found[i]["kept"] for i in (4, 2, 3)] == [False, False, True]


def test_odd_rows(odd_documents, no_documents):
    rows = dedup(odd_documents).collect()
    assert len(rows) == odd_documents.count()
    assert sum(x["kept"] for x in rows) == len({x["digest"] for x in rows})
    same = [x for x in rows if x["copies"] == 3]
    assert len(same) == 3 and {x["keep_key"] for x in same} == {1}
    assert dedup(no_documents).count() == 0
