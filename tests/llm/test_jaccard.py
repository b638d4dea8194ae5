import random
from collections import defaultdict
from itertools import combinations

from stripgrid.llm import groups
from stripgrid.llm.jaccard import Shingles, band_count, keep_one, similar
from stripgrid.llm.queries import op2_jaccard_join


def sets(rows):
    shingles = Shingles()
    return {key: frozenset(shingles(text).tolist()) for key, text in rows}


def groups_of(found):
    """Connected groups of keys at a Jaccard similarity of 0.8, by comparing all pairs."""
    parent = {k: k for k in found}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(found, 2):
        if found[a] and found[b] and len(found[a] & found[b]) >= 0.8 * len(found[a] | found[b]):
            parent[max(root(a), root(b))] = min(root(a), root(b))
    return {k: root(k) for k in found}


def test_bands_reach_the_recall():
    assert (1 - 0.8**5) ** band_count(0.8, 5, 0.999) <= 0.001 < (1 - 0.8**5) ** (band_count(0.8, 5, 0.999) - 1)


def test_query_matches_all_pairs(spark, folder, documents):
    found = {x["doc_id"]: x for x in op2_jaccard_join(spark, folder).collect()}
    wanted = sets([(x["doc_id"], x["text"]) for x in documents.collect()])
    groups = groups_of(wanted)
    assert {k: x["class_id"] for k, x in found.items()} == groups
    members = defaultdict(set)
    for key, grams in wanted.items():
        members[grams].add(key)
    for key, x in found.items():
        if wanted[key]:
            assert x["copies"] == len(members[wanted[key]]) and x["text_id"] == min(members[wanted[key]])


def test_crowded_bucket_keeps_groups(spark):
    """60 texts near one base and 60 near another that share half of it: two groups, though they share buckets."""
    base = [f"w{i}" for i in range(400)]
    other = base[:370] + [f"x{i}" for i in range(60)]
    rows = []
    for k, words in enumerate((base, other)):
        for i in range(60):
            rows.append((100 * k + i, " ".join(words[: 3 * i] + [f"y{i}"] + words[3 * i + 1 :])))
    documents, links = similar(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {x["doc_id"]: x["class_id"] for x in documents.collect()} == groups_of(sets(rows))
    assert links.count() < 60 * 59 and links.where("similarity < 0.8").count() == 0


def brute_links(found):
    pairs = [(a, b) for a, b in combinations(found, 2) if len(found[a] & found[b]) >= 0.8 * len(found[a] | found[b])]
    return {k: sum(k in x for x in pairs) for k in found}, pairs


def test_crowded_bucket_counts_all_links(spark, monkeypatch):
    """300 texts near one base (several blocks), in two classes: every link counts, and can be listed."""
    monkeypatch.setattr(groups, "BLOCK_NODES", 64)
    base = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(base[:i] + [f"y{i}"] + base[i + 1 :] + [f"z{j}" for j in range(i % 2 * 60)])) for i in range(300)]
    wanted, pairs = brute_links(sets(rows))
    documents, links = similar(spark.createDataFrame(rows, "doc_id long, text string"), list_all=True)
    assert {x["doc_id"]: x["n_links"] for x in documents.collect()} == wanted and min(wanted.values()) > 32
    assert sorted(tuple(sorted((x["a_id"], x["b_id"]))) for x in links.collect()) == sorted(pairs)


def test_crowded_texts_make_no_rows_of_pairs(spark, monkeypatch):
    """300 texts near one base, some beyond the threshold: each is sent to a block; no row is a measured pair."""
    draw, written, plain = random.Random(5), [], groups.stored
    monkeypatch.setattr(groups, "stored", lambda x: [y := plain(x), written.append(y.count())][0])
    words = [f"w{i}" for i in range(200)]
    rows = [(k, " ".join([*(f"new{k}" if draw.random() < 0.012 else x for x in words), f"own{k}"])) for k in range(300)]
    wanted, _ = brute_links(sets(rows))
    documents, links = similar(spark.createDataFrame(rows, "doc_id long, text string"))
    found = documents.collect()
    assert {x["doc_id"]: x["class_id"] for x in found} == groups_of(sets(rows))
    total = sum(wanted.values())
    assert all(x["n_links"] <= wanted[x["doc_id"]] for x in found) and 0.998 * total <= sum(x["n_links"] for x in found)
    assert max(written) <= 20 * len(rows) and links.count() < len(rows)


def test_units_split_by_bucket_keep_every_pair(spark):
    """A giant group of few pairs a bucket is not taken whole; its small buckets are rows, its crowded ones blocks, each pair once."""
    members = [(0, i) for i in range(40)] + [(i, x) for i in range(40, 240) for x in (i - 1, i)]
    frame = spark.createDataFrame(members, "bucket long, node long")
    sizes = spark.createDataFrame([(i, 10) for i in range(240)], "node long, size long")
    blocks, pairs = groups.crowds(frame, sizes)
    met = {(x["a"], x["b"]) for x in pairs.collect()}
    units = defaultdict(set)
    for x in blocks.collect():
        units[x["unit"], x["low"], x["high"]].add(x["node"])
    inside = [p for nodes in units.values() for p in combinations(sorted(nodes), 2)]
    assert len(inside) == len(set(inside)) and not met & set(inside)
    assert met | set(inside) == set(combinations(range(40), 2)) | {(i - 1, i) for i in range(40, 240)}


def test_crowded_chain_counts_all_links(spark):
    """A long chain of texts, each near its neighbours only: one group, whose buckets are the units."""
    rows = [(i, " ".join(f"w{j}" for j in range(2 * i, 2 * i + 300))) for i in range(500)]
    wanted, _ = brute_links(sets(rows))
    documents, _ = similar(spark.createDataFrame(rows, "doc_id long, text string"))
    found = {x["doc_id"]: x["n_links"] for x in documents.collect()}
    total = sum(wanted.values())
    assert all(found[k] <= n for k, n in wanted.items()) and sum(found.values()) >= 0.998 * total


def test_keep_one(spark):
    words = " ".join(f"w{i}" for i in range(100))
    rows = [(5, words), (5, words), (3, words + " end"), (9, "alone and different from all the others"), (1, None), (1, None), (None, words)]
    kept = keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((x["doc_id"], x["text"] is None) for x in kept.collect()) == [(1, True), (1, True), (3, False), (9, False)]


def test_odd_rows(odd_documents, no_documents):
    documents, links = similar(odd_documents)
    rows = documents.collect()
    assert len(rows) == odd_documents.count()
    same = [x for x in rows if x["copies"] == 3]
    assert len(same) == 3 and {x["class_id"] for x in same} == {1}
    assert keep_one(odd_documents).columns == odd_documents.columns
    assert keep_one(no_documents).count() == 0
