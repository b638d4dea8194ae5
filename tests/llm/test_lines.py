import random
import re
from collections import defaultdict
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from stripgrid.llm import groups
from stripgrid.llm.lines import SIMILARITY, dedup_lines, word_letters
from stripgrid.llm.queries import op10_line_dedup


def normal(line):
    return re.sub(r"[\W_]+", " ", line.lower()).strip()


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def alike(x, y, x_set, y_set):
    """Edit similarity of two word lists reaches the threshold; words that one list alone has bound the edits from below."""
    near = lambda d: 1 - 2 * d / (len(x) + len(y) + d) >= SIMILARITY
    return near(abs(len(x) - len(y))) and near(len(x_set - y_set)) and near(len(y_set - x_set)) and near(edits(x, y))


def brute(rows):
    """Kept line numbers of each document, by comparing all pairs of different lines."""
    where = defaultdict(list)
    for key, text in rows:
        for i, line in enumerate((text or "").split("\n")):
            if normal(line):
                where[normal(line)].append((key, i))
    parent = {x: x for x in where}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    words = {x: x.split() for x in where}
    sets = {x: frozenset(y) for x, y in words.items()}
    for a, b in combinations(where, 2):
        if alike(words[a], words[b], sets[a], sets[b]):
            parent[root(a)] = root(b)
    first = {}
    for line, places in where.items():
        first[root(line)] = min([*places, first.get(root(line), places[0])])
    lost = {place for line, places in where.items() for place in places if place != first[root(line)]}
    return {key: [i for i, _ in enumerate((text or "").split("\n")) if (key, i) not in lost] for key, text in rows}


def test_query_against_all_pairs(spark, folder, documents):
    """Every line that goes is one that brute force drops; of those that it drops, lines with many changed words may stay."""
    rows = [(x["doc_id"], x["text"]) for x in documents.collect()]
    wanted, texts, lost, missed = brute(rows), dict(rows), 0, 0
    for x in op10_line_dedup(spark, folder).collect():
        lines = texts[x["doc_id"]].split("\n")
        assert x["n_lines"] == len(lines)
        gone = set(range(len(lines))) - set(wanted[x["doc_id"]])
        assert set(x["dropped"]) <= gone and x["text"] == "\n".join(y for i, y in enumerate(lines) if i not in set(x["dropped"]))
        lost, missed = lost + len(gone), missed + len(gone - set(x["dropped"]))
    assert missed <= 0.05 * lost, (missed, lost)


def test_crowded_near_lines(spark):
    base = [f"word{i}x{i * i}" for i in range(150)]
    rows = [(k, " ".join(base[: 3 * k] + [f"new{k}"] + base[3 * k + 1 :])) for k in range(48)]
    rows += [(100, "A short   line!\nits own line\n\na SHORT line"), (101, "its own line")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    wanted, texts = brute(rows), dict(rows)
    found = {x["doc_id"]: x["text"] for x in dedup_lines(frame).collect()}
    assert found == {k: "\n".join(texts[k].split("\n")[i] for i in v) for k, v in wanted.items()}
    assert sum(not x for x in found.values()) >= 10 and found[100] == "A short   line!\nits own line\n" and found[101] == ""


def test_crowded_lines_make_no_rows_of_pairs(spark, monkeypatch):
    """300 lines near one base: what a round writes has a row for each member of a bucket, not one for each measured pair."""
    draw, written, plain = random.Random(5), [], groups.stored
    monkeypatch.setattr(groups, "stored", lambda x: [y := plain(x), written.append(y.count())][0])
    words = [f"word{i}x{i * i}" for i in range(100)]
    rows = [(k, " ".join(f"new{k}" if draw.random() < 0.012 else x for x in words)) for k in range(300)]
    found = {x["doc_id"]: x["dropped"] for x in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found[0] == [] and sum(map(bool, found.values())) >= 295
    assert max(written) <= 6_000


def test_recall_of_one_changed_word(spark):
    """Lines that differ in one word are found whatever their length; lines too far apart never are."""
    draw = random.Random(3)
    words = ["".join(draw.choice("abcdefghijklmnop") for _ in range(draw.randint(2, 11))) for _ in range(5000)]
    rows = []
    for n in (8, 10, 20, 50, 100):
        for _ in range(100):
            line = draw.choices(words, k=n)
            at = draw.randrange(n)
            for text in (line, [*line[:at], "changed", *line[at + 1 :]]):
                rows.append((len(rows), n, " ".join(text)))
    frame = spark.createDataFrame(rows, "doc_id long, n int, text string")
    found = dedup_lines(frame).groupBy("n").agg(F.sum((F.size("dropped") > 0).cast("int")).alias("found"))
    found = {x["n"]: x["found"] for x in found.collect()}
    assert found[8] == 0 and all(90 <= found[n] <= 100 for n in (10, 20, 50, 100))


def test_long_line_of_many_words(spark):
    """Counters of a line with over 2^15 distinct words don't overflow, and its near copy is found."""
    line = [f"word{i}long" for i in range(33_000)]
    rows = [(1, " ".join(line)), (2, " ".join([*line[:77], "new", *line[78:]])), (3, " ".join(line[::-1]))]
    found = {x["doc_id"]: x["dropped"] for x in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found[1] == [] and found[2] in ([], [0])
    assert found[3] in ([], [0])


def test_word_letters(spark):
    rows = spark.createDataFrame([("a b c", "a x c d"), ("uno", "uno"), ("p q", "r s")], "a string, b string")
    got = rows.select(F.levenshtein(word_letters(F.col("a")), word_letters(F.col("b")))).collect()
    assert [x[0] for x in got] == [2, 0, 2]


def test_only_compiled_operators(spark, folder):
    frame = dedup_lines(spark.read.parquet(f"{folder}/documents.parquet"))
    plan = frame._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_odd_rows(odd_documents, no_documents):
    found = dedup_lines(odd_documents)
    assert found.columns == [*odd_documents.columns, "n_lines", "dropped"]
    rows = found.collect()
    assert len(rows) == odd_documents.count()
    assert [x["text"] for x in rows if x["doc_id"] == 1] == [x["text"] for x in odd_documents.where("doc_id = 1").collect()]
    assert [x["text"] for x in rows if x["doc_id"] is None and x["text"] is not None] == [""]
    assert [x["text"] for x in rows if x["doc_id"] == 5] == ["   \n\t\n "]
    assert dedup_lines(no_documents).count() == 0
