import random
from collections import defaultdict
from zlib import crc32

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from stripgrid.llm.packing import TokenIds, Windows, pack
from stripgrid.llm.queries import op5_packing

PATH = public_tokenizers.path("byte_bpe_50k.json")
TOKENIZER = Tokenizer.from_file(PATH)


def exact_ids(text):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids + [1]


def test_ids_equal_the_tokenizers_library():
    draw, tokens = random.Random(1), TokenIds(PATH)
    assert tokens.fast is not None
    parts = ["a", "B", "'s", " ", "  ", "\n", "\t", "é", "1", "23", "!!", "'", "中", "<|endoftext|>", "\x1c", "\x85", "​", "x"]
    texts = ["".join(draw.choice(parts) for _ in range(draw.randint(0, 40))) for _ in range(3000)]
    wanted = [x.ids for x in TOKENIZER.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(x, "<u4").tolist() for x in tokens.ids(texts)] == wanted


def check(pieces, ids_of):
    by_document, by_sequence = defaultdict(list), defaultdict(list)
    for x in pieces:
        by_document[x["doc_id"]].append(x)
        by_sequence[x["sequence_id"]].append(x)
    assert set(by_document) == set(ids_of)
    for key, ids in ids_of.items():
        at = 0
        for x in sorted(by_document[key], key=lambda x: x["start"]):
            part = np.array(ids[at : at + x["length"]], "<u4").tobytes()
            assert x["start"] == at and x["doc_tokens"] == len(ids) and x["ids_crc32"] == crc32(part)
            at += x["length"]
        assert at == len(ids)
    padding = 0
    for x in by_sequence.values():
        at = 0
        for piece in sorted(x, key=lambda x: x["offset"]):
            assert piece["offset"] == at and piece["length"] > 0
            at += piece["length"]
        assert at <= 2048
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    return padding


def test_round_trip(spark, folder, documents):
    ids_of = {x["doc_id"]: exact_ids(x["text"]) for x in documents.collect()}
    assert check(op5_packing(spark, folder).collect(), ids_of) == 0


def test_sum_of_squares_choice():
    """Each placement is the best of all levels, by counting squares outright."""
    draw, windows = random.Random(2), Windows(32)
    for _ in range(500):
        length = draw.choice([5, 7, 11, 13, 20])
        before = windows.level.copy()

        def cost(h):
            level = before.copy()
            level[h] -= h > 0
            if h + length < 32:
                level[h + length] += 1
            return (level[1:32] ** 2).sum()

        options = [0] + [h for h in range(1, 33 - length) if before[h]]
        windows.place(("k", 0, length, bytes(4 * length)), length)
        assert (windows.level[1:32] ** 2).sum() == min(map(cost, options))


def test_settling_when_many_windows_are_open():
    windows, closed = Windows(32, most_open=10), []
    for i in range(100):
        closed += windows.place((i, 0, 20, bytes(80)), 20)
        assert windows.level.sum() <= 11
    closed += windows.settle()
    lengths = [sum(len(x[3]) // 4 for x in w) for w in closed]
    assert sum(lengths) == 2000 and sum(x < 32 for x in lengths) <= 100 // 5


def test_odd_rows(odd_documents, no_documents):
    pieces = pack(odd_documents, "doc_id", "text", PATH).collect()
    assert sum(x["length"] for x in pieces) == sum(len(exact_ids(x["text"])) for x in odd_documents.collect())
    assert pack(no_documents, "doc_id", "text", PATH).count() == 0


@pytest.mark.parametrize("text", [" " * 1_500_000, "\n" * 1_200_000 + "word", "a" + " \t\n" * 500_000 + "b c", "x\x1c" + "\x1c" * 1_100_000])
def test_very_long_white_space(text):
    """The fast encoder gives up on a million of white space; ids stay those of the library."""
    want = Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids
    assert np.frombuffer(TokenIds(PATH).ids([text, "short"])[0], "<u4").tolist() == want
