from zlib import crc32

from pyspark.sql import functions as F

from stripgrid.llm.queries import op1_sharding
from stripgrid.llm.sharding import Permutation, number_rows, shard


def test_permutation_is_a_bijection(spark):
    for rows in (1, 2, 3, 10, 97, 1000, 4097):
        moved = Permutation(spark, rows, seed=rows).apply(spark.range(rows), "id", "to")
        assert sorted(x["to"] for x in moved.collect()) == list(range(rows))


def test_permutation_shuffles(spark):
    moved = {x["id"]: x["to"] for x in Permutation(spark, 5000, 3).apply(spark.range(5000), "id", "to").collect()}
    far = sum(abs(a - b) for a, b in moved.items()) / 5000
    assert 1500 < far < 1850  # a third of the range for a uniform shuffle
    other = {x["id"]: x["to"] for x in Permutation(spark, 5000, 4).apply(spark.range(5000), "id", "to").collect()}
    assert sum(moved[i] == other[i] for i in moved) < 20


def test_numbers_do_not_depend_on_partitions(spark, documents):
    rows = documents.select("doc_id", F.length("text").alias("n"))
    a, n = number_rows(rows.repartition(7), ["doc_id"])
    b, _ = number_rows(rows.repartition(2), ["doc_id"])
    assert n == rows.count()
    assert {tuple(x) for x in a.collect()} == {tuple(x) for x in b.collect()}
    assert [x["row_number"] for x in a.orderBy("doc_id").collect()] == list(range(n))


def test_query(spark, folder):
    found = op1_sharding(spark, folder).toPandas()
    texts = {x["doc_id"]: x["text"] or "" for x in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    assert sorted(found["doc_id"]) == sorted(texts)
    counts = found.groupby("shard").size()
    assert set(counts.index) == set(range(16)) and counts.max() - counts.min() <= 1
    for _, slots in found.groupby("shard")["slot"]:
        assert sorted(slots) == list(range(len(slots)))
    for row in found.itertuples():
        assert row.size == len(texts[row.doc_id].encode()) + 1 and row.text_crc32 == crc32(texts[row.doc_id].encode())


def test_odd_rows(odd_documents, no_documents):
    dealt = shard(odd_documents, 3, ["doc_id", "text"])
    rows = dealt.collect()
    assert len(rows) == odd_documents.count() and sorted(x["row_number"] for x in rows) == list(range(len(rows)))
    assert shard(no_documents, 3, ["doc_id"]).count() == 0
