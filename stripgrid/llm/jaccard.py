"""Similarity join on word n-grams: MinHash bands find candidates, full n-gram sets decide."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stripgrid.functions.lineage import cut_lineage
from stripgrid.llm.common import fresh, stored
from stripgrid.llm.groups import components, crowds

CACHED = 300_000
COLUMNS = 4096


def band_count(threshold: float, rows: int, recall: float) -> int:
    """Bands of ``rows`` hashes that a pair at the threshold misses with probability 1 - recall at most."""
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))


class Shingles:
    """Sorted distinct 64-bit hashes of the n-grams of a text's lower-case words (split at white space).

    A text with fewer than n words has one n-gram, all its words; a text without words has none.
    """

    def __init__(self, n: int = 5):
        self.n, self.words = n, {}

    def __call__(self, text: str | None) -> np.ndarray:
        import xxhash

        words, known = (text or "").lower().split(), self.words
        if not words:
            return np.zeros(0, np.uint64)
        if len(known) > CACHED:
            known.clear()
        for word in set(words):
            if word not in known:
                known[word] = xxhash.xxh3_64_intdigest(word)
        hashes = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        width = max(1, len(words) - self.n + 1)
        out = np.zeros(width, np.uint64)
        for i in range(min(self.n, len(words))):
            out = (out + hashes[i : i + width]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(31)
        return np.unique(out)


class Bands:
    """MinHash values of a set, hashed together in bands."""

    def __init__(self, bands: int, rows: int, seed: int = 1):
        draw = np.random.default_rng(seed)
        self.rows = rows
        self.times = draw.integers(0, 2**31, bands * rows, dtype=np.uint32)[:, None] * np.uint32(2) + np.uint32(1)
        self.plus = draw.integers(0, 2**32, bands * rows, dtype=np.uint32)[:, None]

    def __call__(self, shingles: np.ndarray) -> np.ndarray:
        short, least = (shingles >> np.uint64(32)).astype(np.uint32), None
        for at in range(0, len(short), 1024):
            found = (short[None, at : at + 1024] * self.times + self.plus).min(1)
            least = found if least is None else np.minimum(least, found)
        out = np.arange(1, len(least) // self.rows + 1, dtype=np.uint64)
        for column in least.reshape(-1, self.rows).T:
            out = (out + column) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
        return out.view(np.int64)


def jaccard(a: bytes, b: bytes) -> float:
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    both = np.concatenate((x, y))
    both.sort(kind="stable")  # two sorted runs: one merge
    common = int((both[1:] == both[:-1]).sum())
    return common / (len(both) - common)


def in_common(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """How many values each set of a shares with each set of b."""
    out = np.zeros((len(a), len(b)), np.float32)  # exact up to 2^24
    x, y = np.concatenate(a), np.concatenate(b)
    shared = np.intersect1d(x, y)

    def places(values: np.ndarray, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        rows, at = np.repeat(np.arange(len(sets)), [len(s) for s in sets]), np.searchsorted(shared, values)
        held = np.nonzero(shared[np.minimum(at, len(shared) - 1)] == values)[0]
        held = held[np.argsort(at[held], kind="stable")]
        return rows[held], at[held]

    if len(shared):
        sides = [places(x, a), places(y, b)]
        for first in range(0, len(shared), COLUMNS):
            found = []
            for (rows, at), sets in zip(sides, (a, b)):
                part = slice(*np.searchsorted(at, (first, first + COLUMNS)))
                found.append(np.zeros((len(sets), min(COLUMNS, len(shared) - first)), np.float32))
                found[-1][rows[part], at[part] - first] = 1
            out += found[0] @ found[1].T
    return out


def spanning(links: np.ndarray, one: bool) -> np.ndarray:
    """Of the links between rows and columns (the same nodes if ``one``), enough to connect what they connect."""
    n, m = links.shape
    near = links
    if not one:
        near = np.zeros((n + m, n + m), bool)
        near[:n, n:], near[n:, :n] = links, links.T
    out, left = np.zeros_like(near), np.ones(len(near), bool)
    while left.any():
        front = [int(left.argmax())]
        left[front] = False
        while front:
            x = front.pop()
            new = np.nonzero(near[x] & left)[0]
            out[x, new] = out[new, x] = True
            left[new] = False
            front.extend(new.tolist())
    return out if one else out[:n, n:]


def row_id(frame: DataFrame, key: str, text: str):
    """Rows that agree in key and text share it."""
    return F.xxhash64(key, F.lit("|"), text)


def similar(
    frame: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    n: int = 5,
    threshold: float = 0.8,
    rows: int = 5,
    recall: float = 0.999,
    list_all: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """Join texts with texts whose n-gram sets have a Jaccard similarity of ``threshold`` or more.

    Returns (documents, links). ``documents``: a row per row of the frame - key, ``row_id``, ``class_id`` (smallest key
    of the connected group), ``text_id`` (smallest key among rows with the same n-gram set), ``copies`` (rows with that set),
    ``n_links`` (other sets linked to it). ``links``: (a_id, b_id, similarity) between sets, named by ``text_id``.

    Rows with equal sets become one node before anything is compared. Nodes are shuffled by band hashes; the bands are
    chosen so that a pair at the threshold is found with probability ``recall``; every link is verified on the full
    sets. Sets that share buckets are sent once to a unit and compared there, block of 512 against block (``groups.crowds``), so
    ``n_links`` counts every link whatever the bucket sizes; a block pair writes the counts, and only as many links as connect
    its sets. ``links`` lists these; with ``list_all`` it lists all, which are n * n / 2 for n near copies.

    Null and empty texts have no n-grams: each such row is its own group with no links. Shorter texts have one n-gram. Rows that agree in
    key and text are copies. Other columns are not read. An empty table gives empty results. A null key is a key that is
    larger than all others.
    """
    bands, reach = band_count(threshold, rows, recall), 1 - threshold + 1e-12
    kind = frame.schema[key].dataType
    schema = T.StructType(
        [
            T.StructField("key", kind),
            T.StructField("row_id", T.LongType()),
            T.StructField("node", T.LongType()),
            T.StructField("size", T.LongType()),
            T.StructField("bands", T.ArrayType(T.LongType())),
        ]
    )

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        shingles, banded = Shingles(n), Bands(bands, rows)
        for batch in batches:
            nodes, sizes, found = [], [], []
            for value in batch.column(2):
                grams = shingles(value.as_py())
                nodes.append(xxhash.xxh3_64_intdigest(grams.tobytes()) - 2**63 if len(grams) else None)
                sizes.append(len(grams))
                found.append(banded(grams) if len(grams) else None)
            arrays = [pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(found, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *arrays], names=schema.names)

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(n)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                grams = [shingles(x.as_py()).tobytes() for x in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(grams, pa.binary())], names=["node", "grams"])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            far = [1.0 - jaccard(x.as_py(), y.as_py()) for x, y in zip(batch.column(2), batch.column(3))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(far, pa.float64())], names=["a", "b", "distance"])

    def linked(group: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bool]:
        """Nodes of the two blocks, their links, similarities, and if both are one block (then each link is there both ways)."""
        only, one = group["only"][0].as_py(), group["low"][0].as_py() == group["high"][0].as_py()
        sides = [group.filter(group["is_low"])]
        sides.append(sides[0] if one else group.filter(pc.invert(group["is_low"])))
        names = [x["node"].to_numpy() for x in sides]
        if not len(names[0]) or not len(names[1]):
            return *names, np.zeros((len(names[0]), len(names[1])), bool), np.zeros(0), one
        sets = [[np.frombuffer(y, np.uint64) for y in x["grams"].to_pylist()] for x in sides]
        common = in_common(*sets).astype(np.float64)
        size = [np.array([len(y) for y in x], np.float64) for x in sets]
        near = common / (size[0][:, None] + size[1][None] - common)
        links = 1.0 - near <= reach
        if only is not None:  # a pair counts in the first bucket that it shares
            before = [[np.array([z for z in y if z < only], np.int64) for y in x["buckets"].to_pylist()] for x in sides]
            links &= in_common(*before) == 0
        if one:
            np.fill_diagonal(links, False)
        return *names, links, near, one

    def find_links(group: pa.Table) -> pa.Table:
        """How many links each node has (b is null), then links."""
        a, b, links, near, one = linked(group)
        names, counts = (a, links.sum(1)) if one else (np.concatenate((a, b)), np.concatenate((links.sum(1), links.sum(0))))
        shown = links if list_all else spanning(links, one)
        i, j = np.nonzero(np.triu(shown) if one else shown)
        far = 1.0 - near[i, j] if len(i) else np.zeros(0)
        alone = pa.nulls(len(names), pa.int64())
        columns = [
            pa.concat_arrays([pa.array(names, pa.int64()), pa.array(np.minimum(a[i], b[j]), pa.int64())]),
            pa.concat_arrays([alone, pa.array(np.maximum(a[i], b[j]), pa.int64())]),
            pa.concat_arrays([alone.cast(pa.float64()), pa.array(far, pa.float64())]),
            pa.concat_arrays([pa.array(counts, pa.int64()), pa.nulls(len(i), pa.int64())]),
        ]
        return pa.table(columns, names=["a", "b", "distance", "n_links"])

    texts = frame.select(F.col(key).alias("key"), row_id(frame, key, text).alias("row_id"), F.col(text).alias("text"))
    base = cut_lineage(texts.mapInArrow(sign, schema))
    named = F.struct(F.col("key").isNull().alias("no_key"), "key")
    nodes = cut_lineage(
        base.where("node is not null")
        .groupBy("node")
        .agg(F.count(F.lit(1)).alias("copies"), F.min(named).alias("first"), F.min("row_id").alias("sample"), F.min("size").alias("size"))
    )
    members = base.where("node is not null").select(F.explode("bands").alias("bucket"), "node").distinct()
    shared = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("bucket")
    members = cut_lineage(members.join(shared, "bucket"))
    samples = nodes.join(members.select("node").distinct(), "node").select("node", F.col("sample").alias("row_id"))
    # Several rows may agree with a sample; any of them has the same set.
    grams = cut_lineage(
        texts.join(samples, "row_id").select("node", "text").mapInArrow(sets_of, "node long, grams binary").dropDuplicates(["node"])
    )
    sizes = nodes.select("node", "size")

    def measured(pairs: DataFrame) -> DataFrame:
        side = lambda table, name, value: table.select(F.col("node").alias(name), F.col(value).alias(f"{value}_{name}"))
        sized = pairs.join(side(sizes, "a", "size"), "a").join(side(sizes, "b", "size"), "b")
        bound = 1.0 - F.least("size_a", "size_b") / F.greatest("size_a", "size_b")  # no pair is nearer than its sizes allow
        close = cut_lineage(sized.where(bound <= reach).select("a", "b"))
        both = close.join(side(grams, "b", "grams"), "b").join(side(grams, "a", "grams"), "a")
        both = both.select("a", "b", "grams_a", "grams_b").mapInArrow(measure, "a long, b long, distance double")
        return stored(both.where(F.col("distance") <= reach))

    blocks, rest = crowds(members, sizes)
    buckets = members.join(blocks.where("only is not null").select("node").distinct(), "node")
    buckets = buckets.groupBy("node").agg(F.collect_list("bucket").alias("buckets"))
    filled = blocks.join(grams, "node").join(buckets, "node", "left").groupBy("unit", "low", "high")
    found = stored(filled.applyInArrow(find_links, "a long, b long, distance double, n_links long"))
    pairs, counts = found.where("b is not null").drop("n_links"), found.where("b is null").select(F.col("a").alias("node"), "n_links")
    if rest is not None:
        rest = measured(rest)
        pairs = pairs.unionByName(rest)
        counts = counts.unionByName(rest.select(F.explode(F.array("a", "b")).alias("node"), F.lit(1).cast("long").alias("n_links")))
    groups, degree = components(pairs), counts.groupBy("node").agg(F.sum("n_links").alias("n_links"))
    grouped = nodes.join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    grouped = cut_lineage(grouped.join(degree, "node", "left"))
    classes = grouped.groupBy("component").agg(F.min("first").alias("class"))
    facts = grouped.join(classes, "component").select(
        F.col("node").alias("of"),
        F.col("class.key").alias("class_id"),
        F.col("first.key").alias("text_id"),
        "copies",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
    )
    documents = base.join(facts, F.col("node") == F.col("of"), "left")
    alone = F.col("of").isNull()
    documents = documents.select(
        F.col("key").alias(key),
        "row_id",
        F.when(alone, F.col("key")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(alone, F.col("key")).otherwise(F.col("text_id")).alias("text_id"),
        F.coalesce("copies", F.lit(1)).cast("long").alias("copies"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
    )
    first = nodes.select(F.col("node"), F.col("first.key").alias("id"))
    links = (
        pairs.join(first.select(F.col("node").alias("a"), F.col("id").alias("a_id")), "a")
        .join(first.select(F.col("node").alias("b"), F.col("id").alias("b_id")), "b")
        .select("a_id", "b_id", (1 - F.col("distance")).alias("similarity"))
    )
    return documents, links


def keep_one(frame: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The frame with one row of each group of similar texts: the one with the smallest key, then the smallest row id.

    Of rows that agree in key and text, one stays. Rows without words are groups of their own and all stay. Columns
    are those of the frame.
    """
    documents, _ = similar(frame, key, text, **options)
    documents = documents.withColumn("first", F.struct(F.col(key).isNull().alias("no_key"), F.col(key).alias("key"), "row_id"))
    wordless = documents.where("n_links = 0 and copies = 1").select("row_id")
    grouped = documents.where("n_links > 0 or copies > 1")
    firsts = grouped.groupBy("class_id").agg(F.min("first").alias("first")).select("first.row_id")
    row, nth = fresh(frame, "row_id"), fresh(frame, "nth")
    keepers = firsts.withColumn("once", F.lit(True)).unionByName(wordless.withColumn("once", F.lit(False)).distinct())
    keepers = keepers.withColumnRenamed("row_id", row).withColumnRenamed("once", nth)
    rest = [f"`{x}`" for x in frame.columns]
    marked = frame.withColumn(row, row_id(frame, key, text)).join(keepers, row)
    number = F.expr(f"row_number() over (partition by `{row}` order by `{row}`)")
    return marked.withColumn(row + "_n", number).where(~F.col(nth) | (F.col(row + "_n") == 1)).select(*rest)
