import random
import uuid

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from stripgrid.llm import tokens
from stripgrid.llm.queries import op13_token_counts
from stripgrid.llm.tokens import CACHE, Counter, skips_white_space, token_counts, version_of

WORDS = public_tokenizers.path("word_bpe_49k.json")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def library(path, texts):
    if path.endswith(".model"):
        return [len(x) for x in sentencepiece.SentencePieceProcessor(model_file=path).encode(texts)]
    tokenizer = Tokenizer.from_file(path)
    return [len(tokenizer.encode(x, add_special_tokens=False)) for x in texts]


@pytest.fixture
def cache(tmp_path):
    return str(tmp_path / f"cache-{uuid.uuid4().hex}")


def test_which_files_count_by_words():
    assert [skips_white_space(x) for x in (WORDS, BYTES, PIECES)] == [True, False, False]


# Whatever may behave unlike a letter: all kinds of space, marks that join what stands before, case that depends on the
# neighbours, special strings, digits, joiners, and code points beyond the basic plane.
ALPHABET = (
    [" ", "\t", "\n", "\v", "\f", "\r", "\x1c", "\x85", "\xa0", " ", " ", "　", "​", "﻿", "\0"]
    + ["a", "B", "'", "s", "'S", "'re", "́", "̈", "̧", "ᄀ", "ᅡ", "ᆨ", "Σ", "İ", "ß"]
    + ["<|endoftext|>", "<|startoftext|>", "<|", "|>", "1", "٣", "Ⅷ", ".", "-", "’", "\U0001f600", "\U0001f468‍\U0001f469", "中", "กำ"]
)


def test_counts_by_words_equal_the_library():
    draw = random.Random(11)
    texts = ["".join(draw.choice(ALPHABET) for _ in range(draw.randint(0, 40))) for _ in range(4000)]
    texts += ["", " ", "x" * 5000, " " * 100_000 + "y", "word " * 50_000]
    assert Counter(WORDS, True).counts(texts) == library(WORDS, texts)


def test_a_full_memo_changes_nothing(monkeypatch):
    monkeypatch.setattr(tokens, "MEMO", 3)
    counter, texts = Counter(WORDS, True), ["one two three four five", "six one two", "a" * 600 + " one"]
    assert [counter.counts([x])[0] for x in texts * 2] == library(WORDS, texts * 2)


@pytest.mark.parametrize("path", [WORDS, BYTES, PIECES])
def test_whole_table(spark, documents, cache, path):
    rows = token_counts(documents, "doc_id", "text", path, cache).collect()
    texts = {r.doc_id: r.text or "" for r in documents.collect()}
    assert len(rows) == len(texts)
    want = dict(zip(texts, library(path, list(texts.values()))))
    assert {r.doc_id: (r.n_bytes, r.n_tokens) for r in rows} == {k: (len(x.encode()), want[k]) for k, x in texts.items()}


def test_only_distinct_misses_are_encoded(spark, cache):
    first = spark.createDataFrame([(1, "one two"), (2, " one \n two"), (3, "three"), (4, None)], "doc_id long, text string")
    token_counts(first, "doc_id", "text", WORDS, cache).collect()
    stored = spark.read.schema(CACHE).parquet(cache)
    assert stored.count() == 3  # "one two", "three", ""
    # What the cache says is believed, so a changed entry shows that nothing known is encoded again.
    version = version_of(WORDS)
    other = cache + "-marked"
    stored.withColumn("n_tokens", F.col("n_tokens") + 100).write.partitionBy("tokenizer").parquet(other)
    more = first.unionByName(spark.createDataFrame([(5, "four five six"), (6, "one  two")], first.schema))
    got = {r.doc_id: r.n_tokens for r in token_counts(more, "doc_id", "text", WORDS, other).collect()}
    assert got == {1: 102, 2: 102, 3: 101, 4: 100, 5: 3, 6: 102}
    assert spark.read.schema(CACHE).parquet(other).where(F.col("tokenizer") == version).count() == 4
    # Another tokenizer file shares the folder and no count.
    got = {r.doc_id: r.n_tokens for r in token_counts(more, "doc_id", "text", BYTES, other).collect()}
    assert got == dict(zip(range(1, 7), library(BYTES, ["one two", " one \n two", "three", "", "four five six", "one  two"])))


def test_both_routes_to_the_misses(spark, documents, cache, monkeypatch):
    few = {tuple(r) for r in token_counts(documents, "doc_id", "text", WORDS, cache + "a").drop("digest").collect()}
    monkeypatch.setattr(tokens, "FEW", 0)
    many = {tuple(r) for r in token_counts(documents, "doc_id", "text", WORDS, cache + "b").drop("digest").collect()}
    assert few == many


def test_a_digest_counted_by_two_jobs(spark, cache):
    frame = spark.createDataFrame([(1, "one two")], "doc_id long, text string")
    token_counts(frame, "doc_id", "text", WORDS, cache).collect()
    stored = spark.read.schema(CACHE).parquet(cache).select("tokenizer", "digest", "n_tokens")
    rows = spark.createDataFrame(stored.collect(), CACHE)
    rows.write.partitionBy("tokenizer").mode("append").parquet(cache)
    assert [r.n_tokens for r in token_counts(frame, "doc_id", "text", WORDS, cache).collect()] == [2]


def test_odd_rows(spark, odd_documents, no_documents, cache):
    rows = odd_documents.select("doc_id", "text").collect()
    got = token_counts(odd_documents, "doc_id", "text", WORDS, cache).collect()
    want = zip(rows, library(WORDS, [r.text or "" for r in rows]))
    order = lambda rows: sorted(rows, key=repr)
    assert order((r.doc_id, r.n_bytes, r.n_tokens) for r in got) == order((r.doc_id, len((r.text or "").encode()), n) for r, n in want)
    assert token_counts(no_documents, "doc_id", "text", WORDS, cache + "none").collect() == []


def test_query(spark, folder, documents):
    rows = op13_token_counts(spark, folder)
    assert rows.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    texts = [(r.doc_id, r.text or "") for r in documents.collect()]
    want = {(k, len(x.encode()), n, n > 2048) for (k, x), n in zip(texts, library(WORDS, [x for _, x in texts]))}
    assert {tuple(r) for r in rows.collect()} == want
