from stripgrid.llm.licenses import TEMPLATES, align, longest_increasing, scan_licenses, words_of
from stripgrid.llm.queries import op3_license_scan


def longest_common(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


def test_patience():
    assert longest_increasing([3, 1, 2, 5, 4, 6]) == [1, 2, 4, 5]
    a, b = "x the cat sat on the mat today".split(), "the cat sat upon the mat".split()
    pairs = align(a, b)
    assert all(a[i] == b[j] for i, j in pairs) and len(pairs) == longest_common(a, b)
    assert [i for i, _ in pairs] == sorted(i for i, _ in pairs) and [j for _, j in pairs] == sorted(j for _, j in pairs)


def test_query_matches_a_plain_search(spark, folder, documents):
    """Where a template stands word for word, and only there, it is found; brute force tries every place."""
    found = {x["doc_id"]: x for x in op3_license_scan(spark, folder).collect()}
    for row in documents.collect():
        words, wanted = words_of(row["text"] or ""), set()
        for name, text in TEMPLATES.items():
            template = words_of(text)
            if any(words[i : i + len(template)] == template for i in range(len(words) - len(template) + 1)):
                wanted.add(name)
        exact = {x["license"] for x in found[row["doc_id"]]["spans"] if x["coverage"] == 1.0}
        assert exact == wanted


def test_gaps_repeats_and_places(spark):
    filler = " ".join(f"w{i}" for i in range(3000))
    text = f"{filler} This work is now licensed under the GNU General Public Licence, version 3. {filler} Released under the MIT License. Released under the MIT License."
    row = scan_licenses(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert row["licenses"] == ["GPL-3.0", "MIT", "MIT"] and row["best"] == "MIT" and row["coverage"] == 1.0
    assert row["spans"][0]["start"] == 3000 and 0.8 <= row["spans"][0]["coverage"] < 1


def test_imperfect_notices_before_a_perfect_one(spark):
    one, many = "Released under the MIT licence. Released under the MIT License.", "Released under the MIT licence. " * 20
    rows = [(1, one), (2, many + "Released under the MIT License. " + many)]
    found = {x["doc_id"]: x for x in scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [(x["coverage"], x["start"], x["end"]) for x in found[1]["spans"]] == [(0.8, 0, 4), (1.0, 5, 10)]
    assert found[2]["licenses"] == ["MIT"] * 41 and [x["start"] for x in found[2]["spans"]] == list(range(0, 205, 5))


def test_odd_rows(odd_documents, no_documents):
    rows = scan_licenses(odd_documents).collect()
    assert len(rows) == odd_documents.count() and all(x["best"] is None and x["coverage"] == 0 for x in rows)
    assert scan_licenses(no_documents).count() == 0
