"""Fuzzy line deduplication with SimHash, in column expressions only."""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stripgrid.llm.common import fresh, stored
from stripgrid.llm.groups import components, linked_pairs

CLASSES, LANES = 4, 5  # a word belongs to one class; a class has a block of three bits a lane
SIMILARITY = 0.9
FEWEST = math.ceil(round(1 / (1 - SIMILARITY), 6)) - 1  # one edit in a shorter line is already too much
COUNTED = 2**15  # of a line with k times as many words, one in k (by hash) is counted
SENT_ROWS = 100_000


def normal_line(line: Column) -> Column:
    """Lower case; runs of other characters than letters, marks and digits are one space; trimmed."""
    return F.trim(F.regexp_replace(F.lower(line), r"[^\p{L}\p{M}\p{N}]+", " "))


def weight_of(word: Column) -> Column:
    """A word weighs its length (15 at most), so that short words, which most lines share, don't make them alike."""
    return F.least(F.length(word), F.lit(15)).cast("long")


def fingerprints(words: DataFrame, identity: list[str]) -> DataFrame:
    """(identity, n_words, print, pairs): SimHash of the words (n_words, word) of each line, in one block for each class of words.

    A word's hash says which class it is in and which bits it sets there; a bit of a block is set if words of more than half of the
    class's weight set it. So an edit of a word touches the blocks of one or two classes, and the others stay the same.
    ``pairs`` has a bit for each pair of classes that holds a quarter of the line's weight or more. 15 bits a class are counted, three
    at a time: a sum of longs holds three counters of 21 bits. ``COUNTED`` keeps the counters from overflowing.
    """
    hashed = words.select(*identity, F.xxhash64("word").alias("hash"), weight_of(F.col("word")).alias("weight"), "n_words")
    at = F.shiftrightunsigned("hash", 60).bitwiseAND(F.lit(CLASSES - 1).cast("long"))
    counts = F.shiftrightunsigned("hash", 20) % F.greatest(F.ceil(F.col("n_words") / COUNTED), F.lit(1)) == 0
    ones = 1 + 2**21 + 2**42
    lanes = {"weight": F.col("weight")}
    for lane in range(LANES):
        bits = F.shiftright("hash", 3 * lane).bitwiseAND(F.lit(7).cast("long"))
        lanes[f"lane{lane}"] = (bits * F.lit(1 + 2**20 + 2**40)).bitwiseAND(F.lit(ones)) * F.col("weight")
    masks = [F.when(counts & (at == c), F.lit(-1).cast("long")).otherwise(F.lit(0).cast("long")).alias(f"in_{c}") for c in range(CLASSES)]
    spread = hashed.withColumn("weight", F.coalesce("weight", F.lit(0).cast("long")))
    spread = spread.select(*identity, "n_words", *[x.alias(name) for name, x in lanes.items()], *masks)
    sums = [F.sum(F.col(x).bitwiseAND(F.col(f"in_{c}"))).alias(f"{x}_{c}") for c in range(CLASSES) for x in lanes]
    # A filter on the aggregate stays above it; below, lines would be normalised twice.
    counted = spread.groupBy(*identity).agg(F.max("n_words").alias("n_words"), *sums).where("n_words > 0")
    # Adding 2^20 - threshold to each counter sets its upper bit where the counter reaches the threshold.
    out = F.lit(0).cast("long")
    for c in range(CLASSES):
        half = (F.lit(2**20) - F.expr(f"weight_{c} div 2") - 1) * F.lit(ones)
        for lane in range(LANES):
            full = F.col(f"lane{lane}_{c}") + half
            for part in range(3):
                bit = F.shiftright(full, 20 + 21 * part - part).bitwiseAND(F.lit(1 << part).cast("long"))
                out = out.bitwiseOR(F.shiftleft(bit, 3 * (LANES * c + lane)))
    weight = sum((F.col(f"weight_{c}") for c in range(1, CLASSES)), F.col("weight_0"))
    pairs = F.lit(0)
    for i, (x, y) in enumerate(combinations(range(CLASSES), 2)):
        pairs = pairs + F.when((F.col(f"weight_{x}") + F.col(f"weight_{y}")) * 4 >= weight, F.lit(1 << i)).otherwise(F.lit(0))
    return counted.select(*identity, "n_words", out.alias("print"), pairs.alias("pairs"))


def blocks(fingerprint: Column, pairs: Column) -> Column:
    """Keys of all pairs of blocks that hold enough of the line: a changed word leaves at least two of the four blocks as they are."""
    width = 3 * LANES
    parts = [F.shiftright(fingerprint, width * c).bitwiseAND(F.lit((1 << width) - 1)) for c in range(CLASSES)]
    keys = [
        F.when(pairs.bitwiseAND(F.lit(1 << i)) != 0, F.xxhash64(F.lit(i), parts[x], parts[y]))
        for i, (x, y) in enumerate(combinations(range(CLASSES), 2))
    ]
    return F.array_compact(F.array(*keys))


def word_letters(normal: Column) -> Column:
    """A text with one letter per word (one of a million, by the word's hash), so that edits of words can be counted."""
    code = F.transform(F.split(normal, " "), lambda w: F.lpad(F.hex(F.pmod(F.xxhash64(w), F.lit(1_000_000)) + 65_536), 8, "0"))
    return F.decode(F.unhex(F.array_join(code, "")), "UTF-32")


def _lines(frame: DataFrame, key: str, text: str) -> DataFrame:
    """(key, row_id, line_no, normal): every line, in its normal form."""
    rows = frame.select(F.col(key).alias("key"), F.xxhash64(key, F.lit("|"), text).alias("row_id"), F.col(text).alias("text"))
    exploded = rows.select("key", "row_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return exploded.select("key", "row_id", "line_no", normal_line(F.col("line")).alias("normal"))


def occurrences(frame: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, row_id, line_no, node, check, n_words, print, pairs) of lines with a letter or digit: identity (two hashes) and SimHash.

    Lines of under ``FEWEST`` words resemble no other line and have no print.
    """
    n_words = F.when(F.col("normal") == "", 0).otherwise(F.size(F.split("normal", " ")))
    named = _lines(frame, key, text).select(
        "key", "row_id", "line_no", "normal", F.xxhash64("normal").alias("node"), F.xxhash64(F.lit(1), "normal").alias("check"), n_words.alias("n_words")
    )
    identity = ["key", "row_id", "line_no", "node", "check"]
    none = F.array(F.lit(None).cast("string"))
    each = F.when(F.col("n_words") >= FEWEST, F.array_distinct(F.split("normal", " "))).otherwise(none)
    return fingerprints(named.select(*identity, "n_words", F.explode(each).alias("word")), identity)


def line_groups(frame: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Returns (occurrences, repeated): ``repeated`` has (node, group, first) for lines that occur or resemble more than once.

    Lines are alike if their normal forms are equal, or if their edit similarity 1 - 2d / (|a| + |b| + d), where d words are added,
    removed or replaced, is ``SIMILARITY`` or more. Fingerprints only find the pairs that are compared: those that
    agree in two blocks. The measure is a metric, so crowded buckets are settled against pivots (``groups.linked_pairs``).
    """
    found = stored(occurrences(frame, key, text))
    place = F.struct(F.col("key").isNull().alias("no_key"), "key", "row_id", "line_no")
    nodes = stored(
        found.groupBy("node")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.min(place).alias("first"),
            F.min("n_words").alias("n_words"),
            F.min("print").alias("print"),
            F.min("pairs").alias("pairs"),
            F.min("check").alias("check"),
            F.max("check").alias("other_check"),
        )
        .where(F.col("check") == F.col("other_check"))  # two lines with one hash: neither is touched
        .select("node", "n", "first", "n_words", "print", "pairs")
    )
    members = nodes.where(F.col("n_words") >= FEWEST).select(
        "node", F.col("n_words").alias("size"), F.explode(blocks(F.col("print"), F.col("pairs"))).alias("bucket")
    )
    shared = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    reach = 1 - SIMILARITY + 1e-12

    def values(wanted: DataFrame) -> DataFrame:
        wanted = wanted.join(nodes, "node").select("node", F.col("first.row_id").alias("row_id"), F.col("first.line_no").alias("line_no"))
        wanted = stored(wanted)
        if wanted.count() <= SENT_ROWS:  # 20 bytes each; else both sides are shuffled
            wanted = F.broadcast(wanted)
        rows = frame.select(F.xxhash64(key, F.lit("|"), text).alias("row_id"), F.col(text).alias("text"))
        line = word_letters(normal_line(F.split("text", "\n")[F.col("line_no")]))
        return rows.join(wanted, "row_id").select("node", line.alias("value")).dropDuplicates(["node"])

    def apart(a: Column, b: Column) -> Column:  # no pair is nearer than its lengths allow
        return 2 * F.abs(a - b) / (a + b + F.abs(a - b))

    def distance(a: Column, b: Column) -> Column:
        long = a["size"] + b["size"]
        most = F.floor(long * (reach / (1 - reach)) + 1).cast("int")  # edits at twice the reach
        edits = F.when(apart(a["size"], b["size"]) > 2 * reach, -1).otherwise(F.call_function("levenshtein", a["value"], b["value"], most))
        return F.transform(F.array(edits), lambda d: F.when(d < 0, 1.0).otherwise(2 * d / (long + d)))[0]

    links = linked_pairs(members.join(shared, "bucket"), values, apart, distance, reach)
    grouped = components(links).withColumnRenamed("component", "group")
    repeated = nodes.join(grouped, "node", "left").where((F.col("n") > 1) | F.col("group").isNotNull())
    repeated = stored(repeated.select("node", F.coalesce("group", "node").alias("group"), "first"))
    firsts = repeated.groupBy("group").agg(F.min("first").alias("first"))
    return found, repeated.drop("first").join(firsts, "group").select("node", "group", "first")


def dedup_lines(frame: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The frame without repeated lines: adds ``n_lines`` and ``dropped`` (their numbers, from 0) and rewrites the text.

    Of alike lines (``line_groups``) the one in the row with the smallest key stays (null keys last), and there the
    first. Lines without letter or digit always stay, so texts keep their empty lines. A null text stays null with
    ``n_lines`` null; a text whose lines all go becomes an empty text. Rows that agree in key and text are one document: each
    gets the same text back. Lines may be of any length. An empty table gives an empty result. Columns named like the added ones are replaced.
    """
    found, repeated = line_groups(frame, key, text)
    gone = (
        found.join(repeated, "node")
        .where((F.col("row_id") != F.col("first.row_id")) | (F.col("line_no") != F.col("first.line_no")))
        .groupBy("row_id")
        .agg(F.sort_array(F.collect_set("line_no")).alias("gone"))
    )
    row, lines, lost = fresh(frame, "row_id"), fresh(frame, "all_lines"), fresh(frame, "gone")
    rest = [x for x in frame.columns if x.lower() not in ("n_lines", "dropped")]
    rows = frame.withColumn(row, F.xxhash64(key, F.lit("|"), text))
    rows = rows.join(gone.select(F.col("row_id").alias(row), F.col("gone").alias(lost)), row, "left")
    rows = rows.withColumns({lines: F.split(text, "\n"), lost: F.coalesce(lost, F.array().cast("array<int>"))})
    kept = F.expr(
        f"flatten(transform(sequence(0, size(`{lost}`)), i -> slice(`{lines}`, "
        f"if(i = 0, 1, `{lost}`[i - 1] + 2), "
        f"if(i = size(`{lost}`), size(`{lines}`), `{lost}`[i]) - if(i = 0, 0, `{lost}`[i - 1] + 1))))"
    )
    rewritten = F.when(F.size(lost) == 0, F.col(text)).otherwise(F.array_join(kept, "\n"))
    counted = F.when(F.col(text).isNotNull(), F.size(lines))
    return rows.select(
        *[rewritten.alias(x) if x == text else F.col(f"`{x}`") for x in rest], counted.alias("n_lines"), F.col(lost).alias("dropped")
    )
