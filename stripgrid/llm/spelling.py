"""Spelling variants: frequent words one edit apart, found by comparing dense tiles of padded words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stripgrid.llm.common import stored

RUNS = "[a-zÀ-ÿ]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SLIP = 199
BLOCK = 1024
SMALL = 256


def vocabulary(frame: DataFrame, key: str, text: str, shortest: int = 6, least: int = 5, slip: int = SLIP) -> DataFrame:
    """(word, n): lower-cased letter runs of whole texts with at least ``shortest`` letters and ``least`` occurrences.

    Where ``slip`` divides h, the CRC-32 of ``<key>:<run>``, the letter at h % length is left out: a reproducible slip
    of the pen in one run of 199. Runs that are too short before it are skipped by the pattern already.
    """
    # Each expression stands once: the outer explode and a last filter on both columns of the aggregate are not repeated
    # by the optimizer further down.
    text = F.translate(F.col(text), UPPER, LOWER)
    runs = F.regexp_extract_all(text, F.lit(f"{RUNS}{{{shortest},}}"), F.lit(0))
    words = frame.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("key"), F.explode_outer(runs).alias("run"))
    words = words.select("run", F.crc32(F.concat("key", F.lit(":"), "run")).alias("h"))
    at = F.expr("cast(h % length(run) as int)")
    slipped = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    words = words.select(F.when(F.col("h") % slip == 0, slipped).otherwise(F.col("run")).alias("word"))
    counted = words.groupBy("word").agg(F.count("*").alias("n"))
    return counted.where(F.when(F.length("word") >= shortest, F.col("n")) >= least)


def keys_of(words: DataFrame) -> DataFrame:
    """(span, bucket, word, n): the buckets in which a word meets all words one edit away.

    Two words one edit apart, the longer with ``span`` letters, agree in all letters before some place and in all after
    it, span - 1 together, so in the first or in the last span div 2. A word of length L is the longer or an equal
    one in buckets of span L and the shorter one in those of span L + 1.
    """
    length = F.length("word")
    spans = F.explode(F.array(length, length + 1)).alias("span")
    rows = words.select("word", "n", spans).withColumn("half", F.expr("span div 2").cast("int"))
    ends = F.array(
        F.concat(F.lit("p"), F.substring(F.col("word"), F.lit(1), F.col("half"))),
        F.concat(F.lit("s"), F.substring(F.col("word"), -F.col("half"), F.col("half"))),
    )
    return rows.select("span", F.explode(ends).alias("bucket"), "word", "n")


def tiles_of(keys: DataFrame, block: int = BLOCK) -> DataFrame:
    """(span, bucket, a, b, block, word, n): one tile per bucket, or one per pair of blocks of a crowded bucket.

    Only buckets of more than ``block`` words are in the table that is joined; it is stored, so Spark knows its size, and
    counts were summed before the shuffle. A word of a crowded bucket goes to as many tiles as the bucket has blocks.
    """
    crowded = keys.groupBy("span", "bucket").agg(F.count("*").alias("size")).where(F.col("size") > block)
    crowded = stored(crowded.select("span", "bucket", F.ceil(F.col("size") / block).cast("int").alias("blocks")))
    rows = keys.join(crowded, ["span", "bucket"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    rows = rows.select("span", "bucket", "block", "word", "n", other)
    return rows.select(
        "span", "bucket", F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"), "block", "word", "n"
    )


def padded(words: list[str], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Code points of words, filled up with zeros on the right, and on the left."""
    left = np.array([x.ljust(width, "\0") for x in words], f"<U{width}")
    right = np.array([x.rjust(width, "\0") for x in words], f"<U{width}")
    return tuple(x.view("<u4").reshape(len(words), width) for x in (left, right))


def shared(a: np.ndarray, b: np.ndarray, columns: range) -> np.ndarray:
    """Number of equal code points from the first of ``columns`` on, for every row of a with every row of b."""
    alive = np.ones((len(a), len(b)), bool)
    count = np.zeros((len(a), len(b)), np.uint8 if a.shape[1] < 256 else np.uint32)
    for c in columns:
        alive &= a[:, c, None] == b[None, :, c]
        if not alive.any():
            break
        count += alive
    return count


def compare(words: list[str], n: np.ndarray, tile: np.ndarray, kind: np.ndarray, block: np.ndarray, span: int):
    """(row, near words, best near row) of one or several whole tiles of one span.

    ``kind`` is 0 for prefix buckets, 1 for suffix buckets; there, pairs that share the prefix as well are left out,
    because the prefix bucket has found them. ``block`` is -1 where a tile compares a block with itself.
    """
    order = np.lexsort((np.array(words), -n))  # the best near word of a row is then its first
    words = [words[i] for i in order]
    tile, kind, block = tile[order], kind[order], block[order]
    lengths = np.array([len(x) for x in words])
    left, right = padded(words, span)
    long = np.nonzero(lengths == span)[0]
    prefix = shared(left[long], left, range(span))
    suffix = shared(right[long], right, range(span - 1, -1, -1))
    near = (prefix.astype(np.int32) + suffix >= span - 1) & (prefix < span)
    near &= tile[long, None] == tile[None, :]
    near &= (kind[long, None] == 0) | (prefix < span // 2)
    near &= (block[long, None] != block[None, :]) | (block[long, None] < 0)
    links = np.zeros((len(words), len(words)), bool)
    links[long] = near
    links[:, long] |= near.T
    count = links.sum(1)
    rows = np.nonzero(count)[0]
    return order[rows], count[rows], order[links[rows].argmax(1)] if len(rows) else rows


def near_words(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """(word, n_near, near_n, near): number of words one edit away, and the one with the largest n (ties: the first in
    code-point order), from dense comparison of tiles."""
    tiles = tiles_of(keys_of(words), block)
    order = ["span", "bucket", "a", "b"]
    dealt = tiles.repartition(*order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # whole tiles of one span, and after them the tile that may go on

        def flush(rows: list[tuple]) -> pa.RecordBatch:
            marks, names = np.zeros(len(rows), np.int64), [x[5] for x in rows]
            marks[1:] = np.cumsum([x[:4] != y[:4] for x, y in zip(rows, rows[1:])])
            kind = np.array([x[1][0] == "s" for x in rows]).astype(np.int8)
            block_of = np.array([-1 if x[2] == x[3] else x[4] for x in rows])
            n = np.array([x[6] for x in rows])
            at, count, best = compare(names, n, marks, kind, block_of, rows[0][0])
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([names[i] for i in at], pa.string()),
                    pa.array(count.astype(np.int64)),
                    pa.array(n[best].astype(np.int64)),
                    pa.array([names[i] for i in best], pa.string()),
                ],
                ["word", "n_near", "near_n", "near"],
            )

        whole = 0  # rows of ``held`` that belong to finished tiles
        for batch in batches:
            for row in zip(*(column.to_pylist() for column in batch.columns)):
                if held and held[-1][:4] != row[:4]:
                    if held[-1][0] != row[0] or len(held) >= SMALL:
                        # Small tiles are compared together; a tile that makes it too many goes alone.
                        if whole and len(held) - whole >= SMALL:
                            yield flush(held[:whole])
                            held = held[whole:]
                        yield flush(held)
                        held = []
                    whole = len(held)
                held.append(row)
        if held:
            yield flush(held)

    found = dealt.mapInArrow(run, "word string, n_near long, near_n long, near string")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best")
    found = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best)
    return found.select("word", "n_near", (-F.col("best.less")).alias("near_n"), F.col("best.near").alias("near"))


def roots_of(forms: DataFrame) -> DataFrame:
    """(word, root) for words with a form, level by level from the roots down.

    n grows by ``factor`` at each step, so there are few levels (14 for 10**10 occurrences). The joins are on the
    form, and a form has no more words than there are strings one edit away, so no key is hot.
    """
    forms = stored(forms.select("word", "form"))
    named = forms.select(F.col("word").alias("form"))
    level = stored(forms.join(named, "form", "left_anti").select("word", F.col("form").alias("root")))
    levels = [level]
    while not level.isEmpty():
        above = level.select(F.col("word").alias("form"), "root")
        level = stored(forms.join(above, "form").select("word", "root"))
        levels.append(level)
    result = levels[0]
    for level in levels[1:]:
        result = result.unionByName(level)
    return result


def spelling_variants(
    frame: DataFrame, key: str = "doc_id", text: str = "text", shortest: int = 6, least: int = 5, factor: int = 5
) -> DataFrame:
    """Words of all texts with the more frequent word that each is a variant of: (word, form, root, n, n_near, form_n).

    Words are letter runs (``vocabulary``). Two words are near if one inserted, deleted or replaced code point makes
    one the other: common prefix and suffix together reach the longer length less one. A word's form is its near word of
    largest n (ties: smallest in code-point order) if that is at least ``factor`` times its own n, else null; its root
    is where the chain of forms ends, itself if it has none. ``n_near`` counts all near words.

    Null and empty texts have no words; texts are read whole, however long; each row counts, repeated ones too; a null
    key counts as an empty one. Other columns are not read. An empty table gives no rows. Frequent words are summed
    before any shuffle, and crowded buckets are cut into blocks, so neither makes a task long.
    """
    if shortest < 5:
        raise ValueError("words of fewer than 5 letters need buckets of their own")
    words = stored(vocabulary(frame, key, text, shortest, least))
    near = near_words(words)
    # The near columns travel with the word from here on; the join is on distinct words.
    found = words.join(near, "word", "left").select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(F.col("near_n") >= factor * F.col("n"), F.col("near")).alias("form"),
        F.when(F.col("near_n") >= factor * F.col("n"), F.col("near_n")).alias("form_n"),
    )
    found = stored(found)
    roots = roots_of(found.where("form is not null"))
    joined = found.join(roots, "word", "left")
    return joined.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
