import random
import re
import zlib
from collections import Counter

import pytest

from stripgrid.llm.queries import op12_spelling_variants
from stripgrid.llm.spelling import near_words, roots_of, spelling_variants


def words_of(rows):
    """Words of (key, text) rows by the letter of the contract."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    count = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(lower)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            count[run] += 1
    return {w: n for w, n in count.items() if len(w) >= 6 and n >= 5}


def is_near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(count):
    """Every word against every word."""
    near = {w: [v for v in count if is_near(w, v)] for w in count}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-count[v], v), default=None)
        form[w] = best if best is not None and count[best] >= 5 * count[w] else None
    rows = set()
    for w in count:
        root = w
        while form[root] is not None:
            root = form[root]
        rows.add((w, form[w], root, count[w], len(near[w]), count.get(form[w])))
    return rows


def found(frame):
    rows = [tuple(row) for row in frame.collect()]
    assert frame.columns == ["word", "form", "root", "n", "n_near", "form_n"] and len(rows) == len(set(rows))
    return set(rows)


def texts(seed):
    """Words of few letters, so that many are near each other, with very unequal frequencies."""
    draw = random.Random(seed)
    base = ["".join(draw.choice("abÉ") for _ in range(draw.randint(5, 9))) for _ in range(60)]
    pool = [w for w in base for _ in range(draw.choice([1, 2, 30, 200]))]
    chain = [(-i, " ".join(["chainaa"] * (i < 8) + ["Chainab"] * (i < 45) + ["CHAINBB"])) for i in range(1, 300)]
    return chain + [(i, " ".join(draw.choice([str.upper, str, str.title])(draw.choice(pool)) for _ in range(90))) for i in range(80)]


@pytest.mark.parametrize("seed", [1, 2])
def test_brute_force(spark, seed):
    rows = texts(seed)
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = brute(words_of(rows))
    assert found(spelling_variants(frame)) == want
    assert any(r[1] and r[2] != r[1] for r in want), "no chain of forms"


def test_crowded_buckets_are_cut_into_block_pairs(spark):
    draw = random.Random(3)
    count = {"aaaa" + "".join(draw.choice("abcd") for _ in range(n)): draw.randint(5, 900) for n in (4, 5, 6) for _ in range(150)}
    frame = spark.createDataFrame(list(count.items()), "word string, n long")
    got = {r.word: (r.n_near, r.near_n, r.near) for r in near_words(frame, block=20).collect()}
    want = {}
    for w in count:
        near = sorted((-count[v], v) for v in count if is_near(w, v))
        if near:
            want[w] = (len(near), -near[0][0], near[0][1])
    assert got == want and len(want) > 200


def test_chain_of_forms(spark):
    forms = [(f"w{i}", f"w{i + 1}") for i in range(6)] + [("x", "w3")]
    got = {r.word: r.root for r in roots_of(spark.createDataFrame(forms, "word string, form string")).collect()}
    assert got == {w: "w6" for w, _ in forms}


def test_odd_rows(spark, odd_documents, no_documents):
    rows = [(r.doc_id, r.text) for r in odd_documents.collect()]
    assert found(spelling_variants(odd_documents)) == brute(words_of(rows))
    five = odd_documents
    for _ in range(5):
        five = five.unionByName(odd_documents)
    assert found(spelling_variants(five)) == brute(words_of(rows * 6)) != set()
    assert found(spelling_variants(no_documents)) == set()


def test_very_long_word_and_text(spark):
    rows = [(i, "ab" * 30_000 + " " + "ab" * 30_000 + "x " + "lettersets " * 20_000) for i in range(5)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(spelling_variants(frame)) == brute(words_of(rows))


def test_query_on_whole_table(spark, folder):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    assert found(op12_spelling_variants(spark, folder)) == brute(words_of(rows))
