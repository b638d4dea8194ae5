"""License scans by patience alignment of texts with license templates."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Short notices of common licenses.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "MIT": "Released under the MIT License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "All-rights-reserved": "All rights reserved.",
}
WORD = re.compile(r"[^\W_]+(?:[.\-'][^\W_]+)*")
COVERAGE = 0.8


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def longest_increasing(values: list[int]) -> list[int]:
    """Indices of a longest strictly increasing subsequence, by patience piles."""
    tops, last, before = [], [], []
    for i, value in enumerate(values):
        pile = bisect_left(tops, value)
        before.append(last[pile - 1] if pile else -1)
        if pile == len(tops):
            tops.append(value)
            last.append(i)
        else:
            tops[pile], last[pile] = value, i
    out, i = [], last[-1] if last else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def align(a: list[str], b: list[str], a0: int = 0, b0: int = 0) -> list[tuple[int, int]]:
    """Aligned positions of two word lists.

    Equal words at both ends are matched first. Between them, words that occur once in a and once in b are anchors; a
    longest increasing run of them is kept and the gaps between its anchors are aligned the same way. A gap without an
    anchor gives nothing more.
    """
    done, stack = [], [(0, len(a), 0, len(b))]
    while stack:
        i, m, j, n = stack.pop()
        while i < m and j < n and a[i] == b[j]:
            done.append((i, j))
            i, j = i + 1, j + 1
        while i < m and j < n and a[m - 1] == b[n - 1]:
            m, n = m - 1, n - 1
            done.append((m, n))
        if i == m or j == n:
            continue
        once, there = Counter(a[i:m]), Counter(b[j:n])
        places = {w: k for k, w in enumerate(b[j:n], j) if there[w] == 1}
        anchors = [(k, places[w]) for k, w in enumerate(a[i:m], i) if once[w] == 1 and w in places]
        kept = [anchors[x] for x in longest_increasing([y for _, y in anchors])]
        done += kept
        if kept:
            ends = [(i - 1, j - 1), *kept, (m, n)]
            stack += [(p + 1, r, q + 1, s) for (p, q), (r, s) in zip(ends, ends[1:])]
    return sorted((x + a0, y + b0) for x, y in done)


class Scanner:
    """Finds templates in word lists."""

    def __init__(self, templates: dict[str, str], coverage: float):
        self.coverage = coverage
        self.templates = {name: words_of(text) for name, text in templates.items()}
        self.templates = {name: words for name, words in self.templates.items() if words}
        self.names: dict[str, list[str]] = defaultdict(list)
        for name, words in self.templates.items():
            for word in set(words):
                self.names[word].append(name)

    def windows(self, places: list[int], length: int) -> Iterator[tuple[int, int]]:
        """Stretches of at most 1.5 template lengths that hold enough words of the template, grown by half a length."""
        need, reach, at, found = max(1, int(self.coverage * length)), length + length // 2 + 1, 0, []
        for i in range(len(places)):
            while places[i] - places[at] >= reach:
                at += 1
            if i - at + 1 >= need:
                start, end = places[at] - length // 2, places[i] + 1 + length // 2
                if found and start <= found[-1][1]:
                    found[-1][1] = end
                else:
                    found.append([start, end])
        yield from ((max(0, s), e) for s, e in found)

    def scan(self, text: str | None) -> list[tuple[str, float, int, int]]:
        """(license, coverage, first word, end word) in order of place; of overlapping finds the best stays."""
        words = words_of(text or "")
        places: dict[str, list[int]] = defaultdict(list)
        for i, word in enumerate(words):
            for name in self.names.get(word, ()):
                places[name].append(i)
        found = []
        for name, at in places.items():
            template = self.templates[name]
            if len(at) < self.coverage * len(template):
                continue
            for window in self.windows(at, len(template)):
                starts, known = [i for i in at if window[0] <= i < window[1]], {}
                stretches = [window]
                while stretches:  # one window may hold several notices: beside the best one, both sides may hold more
                    left, right = stretches.pop()
                    best = None
                    for first in starts[bisect_left(starts, left) : bisect_left(starts, right)]:
                        last = min(first + len(template) + len(template) // 2 + 1, right)
                        if last - first < self.coverage * len(template):
                            break
                        if (first, last) not in known:
                            pairs = align(words[first:last], template, first)
                            known[first, last] = (len(pairs) / len(template), pairs[0][0], pairs[-1][0] + 1) if pairs else (0.0, first, first)
                        share = known[first, last][0]
                        if share >= self.coverage and (best is None or share > best[1] + 1e-9):
                            best = (name, *known[first, last])
                            if share == 1.0:
                                break
                    if best is not None:
                        found.append(best)
                        stretches += [(left, best[2]), (best[3], right)]
        kept: list[tuple[str, float, int, int]] = []
        for x in sorted(found, key=lambda x: (-x[1], -(len(self.templates[x[0]])), x[2], x[0])):
            if all(x[3] <= y[2] or x[2] >= y[3] for y in kept):
                kept.append(x)
        return sorted(kept, key=lambda x: x[2])


def scan_licenses(
    frame: DataFrame, templates: dict[str, str] | None = None, key: str = "doc_id", text: str = "text", coverage: float = COVERAGE
) -> DataFrame:
    """A row per row of the frame: key, ``licenses`` (names found, in order), ``best``, ``coverage`` and ``spans``.

    A template is found where patience alignment matches at least ``coverage`` of its words within 1.5 template lengths;
    a span is (license, coverage, start word, end word), words counted from 0 in the whole text. The best license is that of
    the highest coverage, then the longest template, then the first place; null with coverage 0 where there is none. Null and
    empty texts have none. Rows are judged one by one, where they lie, so repeated rows agree and an empty table gives an empty result.
    """
    scanner = Scanner(templates or TEMPLATES, coverage)
    span = T.StructType(
        [
            T.StructField("license", T.StringType()),
            T.StructField("coverage", T.DoubleType()),
            T.StructField("start", T.LongType()),
            T.StructField("end", T.LongType()),
        ]
    )
    schema = T.StructType(
        [
            T.StructField(key, frame.schema[key].dataType),
            T.StructField("licenses", T.ArrayType(T.StringType())),
            T.StructField("best", T.StringType()),
            T.StructField("coverage", T.DoubleType()),
            T.StructField("spans", T.ArrayType(span)),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("license", pa.string()), ("coverage", pa.float64()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            found = [scanner.scan(x.as_py()) for x in batch.column(1)]
            best = [max(x, key=lambda y: (y[1], len(scanner.templates[y[0]]), -y[2]), default=(None, 0.0)) for x in found]
            spans = [[dict(zip(("license", "coverage", "start", "end"), y)) for y in x] for x in found]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([[y[0] for y in x] for x in found], pa.list_(pa.string())),
                    pa.array([x[0] for x in best], pa.string()),
                    pa.array([x[1] for x in best], pa.float64()),
                    pa.array(spans, kind),
                ],
                names=schema.names,
            )

    return frame.select(key, text).mapInArrow(run, schema)
