from zlib import crc32

import numpy as np

from stripgrid.llm.language import LanguageModel, fit, grams, identify, letter_table
from stripgrid.llm.queries import op4_language_id


def test_filters_hold_what_was_added():
    draw = np.random.default_rng(0)
    model = LanguageModel.empty([f"l{i}" for i in range(11)], 2**14)
    known = [draw.integers(0, 2**63, 200, dtype=np.uint64) for _ in range(11)]
    for i, x in enumerate(known):
        model.add(i, x)
    for i, x in enumerate(known):
        assert model.popcounts(x)[i] == 200
    false = model.popcounts(draw.integers(0, 2**63, 20_000, dtype=np.uint64)) / 20_000
    assert np.allclose(false, model.false_rates(), atol=2e-3)


def test_grams():
    letters = letter_table()
    assert len(grams("", letters)) == 0 and len(grams("12 !?", letters)) == 0 and len(grams("a", letters)) == 1
    assert (grams("Äb  c9d", letters) == grams("äB c d", letters)).all()


def test_held_out_accuracy(spark, folder, documents):
    found = {x["doc_id"]: x for x in op4_language_id(spark, folder).collect()}
    rows = documents.collect()
    assert len(found) == len(rows)
    right = total = 0
    for row in rows:
        x = found[row["doc_id"]]
        assert x["held_out"] == (crc32(str(row["doc_id"]).encode()) % 4 == 2) and 0 <= x["score"] <= 1
        if x["held_out"] and row["lang"]:
            right, total = right + (x["lang_pred"] == row["lang"]), total + 1
    assert total > 20 and right / total > 0.95


def test_odd_rows(odd_documents, no_documents):
    model = fit(odd_documents)
    rows = identify(odd_documents, model).collect()
    assert len(rows) == odd_documents.count()
    for row in rows:
        if not any(c.isalpha() for c in row["text"] or ""):
            assert (row["lang_pred"], row["score"]) == ("und", 0.0)
        else:
            assert row["lang_pred"] in ("en", "de", "fr")
    assert identify(no_documents, model).count() == 0
    none = fit(no_documents)
    assert {x["lang_pred"] for x in identify(odd_documents, none).collect()} == {"und"}
