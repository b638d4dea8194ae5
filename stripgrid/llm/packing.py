"""Packing token sequences into windows by the sum-of-squares rule."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from stripgrid.llm.tokens import kept_model

BATCH = 256
LONG_SPACE = 100_000
SPACES = re.compile(r"\s+")
# How byte-level BPE files of this family split a text into words.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in byte-level vocabularies: visible Latin-1 for itself, then from 256 on."""
    visible = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    others = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(others)}


class TokenIds:
    """Token ids of texts as little-endian unsigned 32-bit bytes, from a file of ``tokenizers``.

    Where the file is a plain byte-level BPE whose ids follow its merges, the same vocabulary runs in ``tiktoken``,
    which gives the same ids at a third of the CPU time (tests compare them); any other file runs in ``tokenizers``.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.path = path
        self.fast = self._fast(spec)

    def _whole(self, texts: list[str]) -> list[bytes]:
        import tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        tokenizer = kept_model(tokenizers, self.path, tokenizers.Tokenizer.from_file)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        encoded = tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, "<u4").tobytes() for x in encoded]

    @staticmethod
    def _fast(spec: dict):
        model, pre, letters = spec["model"], spec.get("pre_tokenizer") or {}, byte_letters()
        added = spec.get("added_tokens", [])
        plain = (
            model.get("type") == "BPE"
            and not any(model.get(x) for x in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix"))
            and not model.get("byte_fallback")
            and not model.get("ignore_merges")
            and spec.get("normalizer") is None
            and pre.get("type") == "ByteLevel"
            and not pre.get("add_prefix_space")
            and pre.get("use_regex", True)
            and not any(x["lstrip"] or x["rstrip"] or x["single_word"] for x in added)
        )
        if not plain:
            return None
        vocabulary, special = model["vocab"], {x["content"]: x["id"] for x in added}
        merged = ["".join(x if isinstance(x, list) else x.split(" ")) for x in model["merges"]]
        words = [x for x in vocabulary if x not in special]
        if {vocabulary[x] for x in letters} != set(range(256)) or len(words) != 256 + len(merged):
            return None
        if any(vocabulary.get(x) != 256 + i for i, x in enumerate(merged)):
            return None
        import tiktoken

        ranks = {bytes(map(letters.__getitem__, x)): vocabulary[x] for x in words}
        return tiktoken.Encoding("file", pat_str=WORDS, mergeable_ranks=ranks, special_tokens=special)

    def ids(self, texts: list[str]) -> list[bytes]:
        if self.fast is None:
            return self._whole(texts)
        return [
            self._whole([x])[0] if long_space(x) else self.fast.encode_to_numpy(x, allowed_special="all").astype("<u4").tobytes()
            for x in texts
        ]


def long_space(text: str) -> bool:
    """Whether a run of white space is so long that the fast encoder's pattern gives up on it (it tracks back over a run,
    up to a million steps); such a text runs in the tokenizer's own library."""
    return len(text) > LONG_SPACE and any(len(run) > LONG_SPACE for run in SPACES.findall(text))


class Windows:
    """Open windows of one task, by fill level, with the number of windows at each level in one array."""

    def __init__(self, size: int, most_open: int = 4096):
        self.size, self.most_open = size, most_open
        self.level = np.zeros(size + 1, np.int64)
        self.open: list[list[list]] = [[] for _ in range(size + 1)]

    def place(self, piece: tuple, length: int) -> list[list]:
        """Put a piece where the sum of squared counts of partly filled windows grows least; return full windows."""
        n, s = self.level, self.size
        if length == s:
            return [[piece]]
        # Taking a window from level h and putting one at level h + length: (N-1)^2 - N^2 and (N+1)^2 - N^2.
        change = np.where(n[1 : s - length + 1] > 0, 1 - 2 * n[1 : s - length + 1], 2**62)
        change[:-1] += 1 + 2 * n[1 + length : s]
        best = len(change) - 1 - int(change[::-1].argmin())
        if change[best] <= 1 + 2 * n[length]:
            h = best + 1
            window = self.open[h].pop()
            n[h] -= 1
        else:
            h, window = 0, []
        window.append(piece)
        if h + length == s:
            return [window]
        self.open[h + length].append(window)
        n[h + length] += 1
        return self.settle(keep=self.most_open // 2) if n.sum() > self.most_open else []

    def settle(self, keep: int = 0) -> list[list]:
        """Close open windows but the ``keep`` fullest: the fuller ones are topped up with cuts of the emptier ones."""
        levels = [h for h in range(self.size, 0, -1) for _ in self.open[h]]
        windows = [w for h in range(self.size, 0, -1) for w in self.open[h]]
        closing, levels = windows[keep:], levels[keep:]
        for h in {*levels}:
            kept = len(self.open[h]) - levels.count(h)
            self.open[h], self.level[h] = self.open[h][:kept], kept
        done, i, j = [], 0, len(closing) - 1
        while i < j:
            need = self.size - levels[i]
            while need and j > i:
                piece = closing[j].pop()
                length = len(piece[3]) // 4
                if length > need:
                    head, tail = cut(piece, need)
                    closing[j].append(tail)
                    piece, length = head, need
                closing[i].append(piece)
                need -= length
                levels[i] += length
                levels[j] -= length
                j -= not closing[j]
            if not need:
                done.append(closing[i])
                i += 1
        return done + [closing[k] for k in range(i, j + 1) if closing[k]]


def cut(piece: tuple, at: int) -> tuple[tuple, tuple]:
    key, start, tokens, ids = piece
    return (key, start, tokens, ids[: 4 * at]), (key, start + at, tokens, ids[4 * at :])


def powers(window: list) -> Iterator[list]:
    """Cut the last, partly filled window into sequences whose lengths are powers of two, the largest first."""
    left, rest = sum(len(x[3]) // 4 for x in window), list(window)
    while left:
        size = 1 << (left.bit_length() - 1)
        left, need, part = left - size, size, []
        while need:
            piece = rest.pop(0)
            if len(piece[3]) // 4 > need:
                piece, tail = cut(piece, need)
                rest.insert(0, tail)
            part.append(piece)
            need -= len(piece[3]) // 4
        yield part


def pack(
    frame: DataFrame, key: str, text: str, tokenizer_path: str, window: int = 2048, end_id: int = 1
) -> DataFrame:
    """Pack documents into token sequences of at most ``window`` ids.

    Returns a row per piece: the key column, ``start``, ``length``, ``doc_tokens``, ``sequence_id``, ``offset`` and
    ``ids`` (little-endian unsigned 32-bit). A document is its token ids and then ``end_id``; null text counts as
    empty, so it is ``end_id`` alone. Whole windows are cut off long documents; the rest of a document goes where the
    sum-of-squares rule says, in the order of the rows. When a task ends, its partly filled windows are topped up with
    cuts of each other; the last one becomes sequences whose lengths are powers of two, which need no padding.

    There is no shuffle: a task packs its own rows, keeps at most ``most_open`` windows of metadata and ids, and gives
    ``sequence_id`` its partition number in the upper bits. Repeated rows are packed one by one, other columns are not
    read, an empty table gives no rows. Packing a table that is read in a fixed order (files) gives the same pieces
    again when a task is repeated.
    """
    key_type = frame.schema[key].dataType
    schema = T.StructType(
        [
            T.StructField(key, key_type),
            *[T.StructField(x, T.LongType()) for x in ("start", "length", "doc_tokens", "sequence_id", "offset")],
            T.StructField("ids", T.BinaryType()),
        ]
    )
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, windows, kind = TokenIds(tokenizer_path), Windows(window), None
        sequence = TaskContext.get().partitionId() << 32

        def rows(closed: list[list]) -> pa.RecordBatch:
            nonlocal sequence
            out: list[list] = [[] for _ in range(7)]
            for pieces in closed:
                offset = 0
                for name, start, n, ids in pieces:
                    length = len(ids) // 4
                    for column, value in zip(out, (name, start, length, n, sequence, offset, ids)):
                        column.append(value)
                    offset += length
                sequence += 1
            kinds = [kind, *[pa.int64()] * 5, pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds)], names=schema.names)

        for batch in batches:
            kind = batch.schema.field(0).type
            for at in range(0, batch.num_rows, BATCH):
                part, closed = batch.slice(at, BATCH), []
                names = part.column(0).to_pylist()
                for name, ids in zip(names, tokens.ids([x or "" for x in part.column(1).to_pylist()])):
                    ids += end
                    n, start = len(ids) // 4, 0
                    while n - start >= window:
                        closed.append([(name, start, n, ids[4 * start : 4 * (start + window)])])
                        start += window
                    if n > start:
                        closed += windows.place((name, start, n, ids[4 * start :]), n - start)
                if closed:
                    yield rows(closed)
        if kind is not None:
            closed = windows.settle()
            if closed and sum(len(x[3]) // 4 for x in closed[-1]) < window:
                closed += powers(closed.pop())
            if closed:
                yield rows(closed)

    return frame.select(key, text).mapInArrow(run, schema)
