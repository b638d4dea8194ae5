"""Hard negatives by exact integer products, several candidates packed in each multiplied number."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stripgrid.llm.common import stored

ANCHORS = 1024
PARTS = 32
SLICE = 2048
# A double holds every integer below 2**53 exactly; the top places stay free for positions in a slice.
EXACT_BITS = 53
FAST_BITS = 48
WIDE_FIELDS = 16
LARGEST = 2**31
NONE = np.iinfo(np.int64).min


@dataclass(frozen=True)
class Fields:
    """Layout of packed candidates: every component plus ``bias`` is at least 0, and a field of ``bits`` bits holds the
    product sum of any two biased vectors, so fields never run into each other."""

    size: int
    bias: int
    bits: int

    @staticmethod
    def of(size: int, least: int, most: int) -> Fields:
        return Fields(size, -least, max(1, (size * (most - least) ** 2).bit_length()))

    @property
    def fast(self) -> bool:
        return self.bits <= FAST_BITS

    @property
    def count(self) -> int:
        """Candidates to a number: as many as stay exact in a double, or 16 in a Python integer of any length."""
        return EXACT_BITS // self.bits if self.fast else WIDE_FIELDS

    def anchors(self, rows: np.ndarray) -> np.ndarray:
        return (rows + self.bias).astype(np.float64 if self.fast else object)

    def pack(self, rows: np.ndarray) -> np.ndarray:
        """Numbers x components: candidates i * count .. i * count + count - 1 side by side in number i."""
        padded = np.full((-(-len(rows) // self.count) * self.count, self.size), 0, np.int64)
        padded[: len(rows)] = rows + self.bias
        fields = padded.reshape(-1, self.count, self.size)
        if not self.fast:
            fields = fields.astype(object)
        return sum(fields[:, f] << (self.bits * f) for f in range(self.count))

    def scores(self, anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Exact inner products, anchors x candidates: one multiplication for ``count`` candidates and a component.

        (a + bias)(x + bias) = a x + bias (a + x) + bias^2, so three known terms are taken off each unpacked field.
        """
        packed = self.pack(rows)
        if self.fast:
            product = (self.anchors(anchors) @ packed.astype(np.float64).T).astype(np.int64)
        else:
            product = self.anchors(anchors).dot(packed.T)
        mask = (1 << self.bits) - 1
        kind = np.int64 if self.fast else object
        out = np.empty((len(anchors), len(packed), self.count), kind)
        for f in range(self.count):
            out[:, :, f] = (product >> (self.bits * f)) & mask
        out = out.reshape(len(anchors), -1)[:, : len(rows)]
        mine, theirs = anchors.astype(kind).sum(1), rows.astype(kind).sum(1)
        return out - self.bias * (mine[:, None] + theirs[None, :]) - self.size * self.bias**2


class Best:
    """The best ``k`` (score, key) of each anchor so far: larger scores first, then smaller keys."""

    def __init__(self, rows: int, k: int):
        self.k = k
        self.scores = np.full((rows, k), NONE, np.int64)
        self.keys = np.zeros((rows, k), np.int64)

    def take(self, scores: np.ndarray, allowed: np.ndarray, keys: np.ndarray) -> None:
        """``keys`` are in rising order, so the position stands for the key when scores are equal."""
        if not allowed.any():
            return
        if scores.dtype == object:
            found, at = self._take_wide(scores, allowed, keys)
        else:
            places = np.arange(len(keys) - 1, -1, -1)
            marked = np.where(allowed, scores * SLICE + places, NONE)
            if marked.shape[1] > self.k:
                marked = np.partition(marked, marked.shape[1] - self.k, axis=1)[:, -self.k :]
            at = keys[len(keys) - 1 - marked % SLICE] if len(keys) == SLICE else keys[np.clip(len(keys) - 1 - marked % SLICE, 0, None)]
            found = np.where(marked == NONE, NONE, marked // SLICE)
        scores, keys = np.hstack([self.scores, found]), np.hstack([self.keys, at])
        # The complement orders from largest to smallest and, unlike the negative, exists for every long.
        order = np.lexsort((keys, ~scores), axis=1)[:, : self.k]
        self.scores, self.keys = np.take_along_axis(scores, order, 1), np.take_along_axis(keys, order, 1)

    def _take_wide(self, scores: np.ndarray, allowed: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        found, at = np.full((len(scores), self.k), NONE, np.int64), np.zeros((len(scores), self.k), np.int64)
        for i, row in enumerate(scores):
            best = heapq.nsmallest(self.k, np.nonzero(allowed[i])[0], key=lambda j: (-row[j], keys[j]))
            for place, j in enumerate(best):
                if abs(row[j]) >= 2**63:
                    raise OverflowError("an inner product does not fit a long")
                found[i, place], at[i, place] = row[j], keys[j]
        return found, at


def whole_vectors(rows: DataFrame, scale: int) -> DataFrame:
    """(key, label, anchor, size, least, most, vector): components as 32-bit integers, one row per key."""

    def floor(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(batch.column("vector").is_valid())
            lists = batch.column("vector")
            lengths = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            owners = np.repeat(np.arange(len(lengths)), lengths)
            bad = np.bincount(owners[~np.isfinite(flat)], minlength=len(lengths)) > 0
            good = ~bad & (lengths > 0)
            keep = good[owners]
            whole = np.floor(scale * flat[keep])
            if (np.abs(whole) >= LARGEST).any():
                raise OverflowError(f"a component times {scale} is beyond 32 bits")
            lengths = lengths[good]
            starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64) if len(lengths) else []
            whole = whole.astype("<i4")
            batch = batch.filter(pa.array(good))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("key"),
                    batch.column("label"),
                    batch.column("anchor"),
                    pa.array(lengths.astype(np.int32)),
                    pa.array(np.minimum.reduceat(whole, starts) if len(lengths) else whole),
                    pa.array(np.maximum.reduceat(whole, starts) if len(lengths) else whole),
                    pa.array([whole[s : s + n].tobytes() for s, n in zip(starts, lengths)], pa.binary()),
                ],
                ["key", "label", "anchor", "size", "least", "most", "vector"],
            )

    schema = "key long, label long, anchor boolean, size int, least int, most int, vector binary"
    rest = ("label", "size", "vector", "anchor", "least", "most")
    first = rows.mapInArrow(floor, schema).groupBy("key").agg(F.min(F.struct(*rest)).alias("row"))
    return first.select("key", "row.*")


def scan(anchors: DataFrame, rows: DataFrame, fields: Fields, blocks: int, positives: int, negatives: int, band) -> DataFrame:
    """Every anchor against every row: (anchor_id, positive_id, positive_score, key, score).

    Anchors are dealt to ``blocks`` blocks, rows to ``PARTS`` parts; a group is one block and one part. Its anchors come
    first in the sorted partition, then its rows stream by, ``SLICE`` at a time, and only the best of each anchor
    are kept. So a task holds one block of anchors and one slice, whatever the table holds, and what it emits grows with
    the number of anchors. Without ``band`` the best rows of the anchor's label are returned, as positives.
    """
    place = F.pmod(F.xxhash64("key", F.lit(1)), F.lit(blocks)).cast("int")
    part = F.pmod(F.xxhash64("key"), F.lit(PARTS)).cast("int")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    bounds = ["positive_ids", "positive_scores"] if band else []
    empty = [F.lit(None).cast("array<long>").alias(name) for name in bounds]
    first = anchors.select(place.alias("block"), spread(PARTS).alias("part"), F.lit(0).alias("kind"), "key", "label", "vector", *bounds)
    then = rows.select(spread(blocks).alias("block"), part.alias("part"), F.lit(1).alias("kind"), "key", "label", "vector", *empty)
    order = ["block", "part", "kind", "key"]
    dealt = first.unionByName(then).repartition("block", "part").sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = None
        for batch in batches:
            places = np.stack([batch.column(name).to_numpy() for name in order[:3]], 1)
            cuts = np.nonzero((places[1:] != places[:-1]).any(1))[0] + 1
            for a, b in zip([0, *cuts], [*cuts, len(places)]):
                if a == b:
                    continue
                if group is None or group.place != tuple(places[a, :2]):
                    if group is not None:
                        yield group.result()
                    group = Group(tuple(places[a, :2]), fields, positives, negatives, band)
                group.take(batch.slice(a, b - a), places[a, 2])
        if group is not None:
            yield group.result()

    return dealt.mapInArrow(run, "anchor_id long, positive_id long, positive_score long, key long, score long")


class Group:
    """One block of anchors and the rows of one part."""

    def __init__(self, place: tuple, fields: Fields, positives: int, negatives: int, band):
        self.place, self.fields, self.positives, self.negatives, self.band = place, fields, positives, negatives, band
        self.waiting: list[pa.RecordBatch] = []
        self.anchors = None

    def vectors(self, batch) -> np.ndarray:
        return np.frombuffer(b"".join(batch["vector"].to_pylist()), "<i4").reshape(-1, self.fields.size).astype(np.int64)

    def take(self, batch: pa.RecordBatch, kind: int) -> None:
        if kind == 0:
            self.waiting.append(batch)
            return
        if not self.waiting:
            return
        if self.anchors is None:
            self.open()
        for at in range(0, batch.num_rows, SLICE):
            piece = batch.slice(at, SLICE)
            keys, labels = piece["key"].to_numpy(), piece["label"].to_numpy()
            scores = self.fields.scores(self.anchors, self.vectors(piece))
            same = self.labels[:, None] == labels[None, :]
            if not self.band:
                self.best[0].take(scores, same & (self.keys[:, None] != keys[None, :]), keys)
                continue
            for p, best in enumerate(self.best):
                inside = (scores >= self.low[:, p : p + 1]) & (scores <= self.high[:, p : p + 1])
                best.take(scores, inside & ~same, keys)

    def open(self) -> None:
        table = pa.Table.from_batches(self.waiting)
        self.anchors, self.keys, self.labels = self.vectors(table), table["key"].to_numpy(), table["label"].to_numpy()
        if not self.band:
            self.best = [Best(len(self.keys), self.positives)]
            return
        lists = table["positive_ids"].to_pylist(), table["positive_scores"].to_pylist()
        self.ids, self.found = np.zeros((2, len(self.keys), self.positives), np.int64)
        self.low, self.high = np.zeros((2, len(self.keys), self.positives), np.int64)
        self.high -= 1  # where there is no positive, no score is between the bounds
        for i, (ids, scores) in enumerate(zip(*lists)):
            for p, (name, score) in enumerate(zip(ids, scores)):
                self.ids[i, p], self.found[i, p] = name, score
                self.low[i, p], self.high[i, p] = -(-score * self.band[0] // 100), score * self.band[1] // 100
        self.best = [Best(len(self.keys), self.negatives) for _ in range(self.positives)]

    def result(self) -> pa.RecordBatch:
        columns: list[list] = [[] for _ in range(5)]
        for p, best in enumerate(self.best if self.anchors is not None else []):
            row, at = np.nonzero(best.scores != NONE)
            ids, found = (self.ids[row, p], self.found[row, p]) if self.band else (self.keys[row] * 0, self.keys[row] * 0)
            for column, values in zip(columns, (self.keys[row], ids, found, best.keys[row, at], best.scores[row, at])):
                column.append(values)
        names = ["anchor_id", "positive_id", "positive_score", "key", "score"]
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c) if c else [], pa.int64()) for c in columns], names)


def hard_negatives(
    frame: DataFrame,
    anchor: Column,
    label: Column,
    key: str = "vec_id",
    vector: str = "embedding",
    positives: int = 5,
    negatives: int = 10,
    band: tuple[int, int] = (30, 90),
    scale: int = 256,
) -> DataFrame:
    """Mine (anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    A component x becomes floor(scale * x); a score is the integer inner product of two rows. An anchor (a row for which
    ``anchor`` is true) has as positives its ``positives`` best other rows of the same label; for each of them the
    ``negatives`` best rows of another label come back whose score is between ``band`` percent of the positive's score,
    bounds included. Larger scores come first, ties go to the smaller key. All rows are scored, exactly.

    Scores come from Kronecker products: a bias makes components non-negative, several candidates' components are shifted
    into separate fields of one integer, which is multiplied once per anchor component; the fields of the sum are the
    candidates' biased scores. Integers below 2**53 run as doubles; larger products in Python integers of any length.

    Rows with a null key, label or vector, an empty vector, or a null or non-finite component take no part, nor do
    vectors of another length than most rows have (ties: the shorter). Of rows that share a key, the one with the
    smallest (label, length, vector bytes) counts, so repeated rows count once. A positive with a score below 0 has no
    negatives, since its band is empty. A component beyond 31 bits after scaling, or a score beyond a long, is an error.
    An empty table, or one without anchors, gives no rows; text plays no part, other columns are not read. Labels may be
    as unequal as they like: rows are dealt by key.
    """
    rows = frame.select(
        F.col(key).cast("long").alias("key"),
        label.cast("long").alias("label"),
        F.coalesce(anchor, F.lit(False)).alias("anchor"),
        F.col(vector).cast("array<double>").alias("vector"),
    ).where("key is not null and label is not null and vector is not null")
    rows = stored(whole_vectors(rows, scale))
    sizes = rows.groupBy("size").agg(
        F.count("*").alias("n"), F.count_if("anchor").alias("anchors"), F.min("least").alias("least"), F.max("most").alias("most")
    )
    common = sizes.orderBy(F.desc("n"), "size").first()
    if common is None or not common["anchors"]:
        names = ("anchor_id", "positive_id", "negative_id", "positive_score", "negative_score")
        return frame.sparkSession.createDataFrame([], "rank int, " + ", ".join(f"{x} long" for x in names)).select(*OUT)
    fields = Fields.of(common["size"], common["least"], common["most"])
    blocks = -(-common["anchors"] // ANCHORS)
    rows = rows.where(F.col("size") == common["size"]).select("key", "label", "anchor", "vector")
    anchors = rows.where("anchor")

    near = scan(anchors, rows, fields, blocks, positives, negatives, None)
    rank = F.expr("cast(row_number() over (partition by anchor_id, positive_id order by score desc, key) as int)")
    near = near.withColumn("rank", rank).where(F.col("rank") <= positives)
    listed = F.sort_array(F.collect_list(F.struct("rank", "key", "score")))
    near = near.groupBy(F.col("anchor_id").alias("key")).agg(listed.alias("found"))
    near = near.select("key", F.col("found.key").alias("positive_ids"), F.col("found.score").alias("positive_scores"))

    hard = scan(anchors.join(near, "key"), rows, fields, blocks, positives, negatives, band)
    hard = hard.withColumn("rank", rank).where(F.col("rank") <= negatives)
    return hard.withColumnsRenamed({"key": "negative_id", "score": "negative_score"}).select(*OUT)


OUT = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
