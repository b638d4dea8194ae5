"""Exact deduplication on a sharded index of live digests: cuckoo filters in front of bucketed content."""

from __future__ import annotations

from array import array
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stripgrid.functions.lineage import cut_lineage
from stripgrid.llm.common import WHITE

SLOTS = 4
KICKS = 200
SHARD_ROWS = 20_000


class CuckooFilter:
    """16-bit fingerprints in buckets of four, each with two possible buckets; supports deletion.

    Filter and content belong together: ``content`` holds the full digests of each bucket pair, so a fingerprint hit is
    verified against the digests that share its first bucket, and when an insertion finds no place the filter is
    rebuilt at twice the size from those stored digests. A digest is its lowercase hex string.
    """

    def __init__(self, digests: dict[str, tuple] | None = None):
        self.live: dict[str, tuple] = {}
        self.resized = 0
        self._make(16)
        for digest, value in (digests or {}).items():
            self.insert(digest, value)

    def _make(self, buckets: int) -> None:
        self.buckets, self.table = buckets, array("H", bytes(2 * SLOTS * buckets))
        self.content: list[list[str]] = [[] for _ in range(buckets)]

    def _place(self, digest: str) -> tuple[int, int]:
        number = int(digest[:16], 16)
        return (number & 0xFFFF) or 1, (number >> 16) & (self.buckets - 1)

    def _other(self, bucket: int, mark: int) -> int:
        return (bucket ^ (mark * 0x5BD1E995 >> 7)) & (self.buckets - 1)

    def _put(self, bucket: int, mark: int) -> bool:
        for at in range(SLOTS * bucket, SLOTS * bucket + SLOTS):
            if not self.table[at]:
                self.table[at] = mark
                return True
        return False

    def maybe(self, digest: str) -> bool:
        mark, first = self._place(digest)
        second = self._other(first, mark)
        return mark in self.table[SLOTS * first : SLOTS * first + SLOTS] or mark in self.table[SLOTS * second : SLOTS * second + SLOTS]

    def find(self, digest: str) -> bool:
        """A filter hit, verified on the digests of the bucket."""
        return self.maybe(digest) and digest in self.content[self._place(digest)[1]]

    def insert(self, digest: str, value: tuple) -> None:
        self.live[digest] = value
        mark, bucket = self._place(digest)
        self.content[bucket].append(digest)
        if self._put(bucket, mark):
            return
        for turn in range(KICKS):
            bucket = self._other(bucket, mark)
            if self._put(bucket, mark):
                return
            at = SLOTS * bucket + turn % SLOTS
            self.table[at], mark = mark, self.table[at]
        self._grow()

    def _grow(self) -> None:
        self.resized += 1
        stored, self.live = self.live, {}
        self._make(2 * self.buckets)
        for digest, value in stored.items():
            self.insert(digest, value)

    def delete(self, digest: str) -> bool:
        if not self.find(digest):
            return False
        mark, first = self._place(digest)
        for bucket in (first, self._other(first, mark)):
            for at in range(SLOTS * bucket, SLOTS * bucket + SLOTS):
                if self.table[at] == mark:
                    self.table[at] = 0
                    self.content[first].remove(digest)
                    del self.live[digest]
                    return True
        return False


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), WHITE, "")


@dataclass
class DigestIndex:
    """Live digests as a table: (shard, digest, copies, points, no_key, key, row) - one row for each digest.

    ``key`` and ``row`` name the best row of the group: most code points, then smallest key (null keys last), then
    first in the table. Shards are dealt by digest and hold about ``SHARD_ROWS`` digests; a batch is applied to all
    shards side by side, each through the cuckoo filter that is built from the shard's stored digests.
    """

    rows: DataFrame
    shards: int

    COLUMNS = "shard int, digest string, copies long, points long, no_key boolean, key long, row long"

    @classmethod
    def empty(cls, spark, expected: int) -> DigestIndex:
        return cls(spark.createDataFrame([], cls.COLUMNS), max(1, -(-expected // SHARD_ROWS)))

    def _shard(self, digest: str = "digest") -> Column:
        return F.pmod(F.xxhash64(digest), F.lit(self.shards)).cast("int")

    def _apply(self, batch: DataFrame, action: str) -> DigestIndex:
        names = [x.split()[0] for x in self.COLUMNS.split(", ")]

        def run(table: pa.Table) -> pa.Table:
            rows = table.to_pydict()
            shard, index = rows["shard"][0] if table.num_rows else 0, CuckooFilter()
            order = sorted(range(table.num_rows), key=lambda i: rows["action"][i])  # "0" stored, "1" the batch
            for i in order:
                digest = rows["digest"][i]
                value = tuple(rows[x][i] for x in names[2:])
                if rows["action"][i] == "2":
                    index.delete(digest)
                elif index.find(digest):
                    copies, *best = index.live[digest]
                    rank = lambda v: (-v[0], v[1], v[2] if v[2] is not None else 0, v[3])
                    index.live[digest] = (copies + value[0], *min(best, list(value[1:]), key=rank))
                else:
                    index.insert(digest, value)
            kept = [(shard, digest, *value) for digest, value in index.live.items()]
            fields = [pa.field(n, t) for n, t in zip(names, (pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64()))]
            return pa.table([pa.array([x[c] for x in kept], f.type) for c, f in enumerate(fields)], schema=pa.schema(fields))

        both = self.rows.withColumn("action", F.lit("0")).unionByName(
            batch.withColumn("shard", self._shard()).withColumn("action", F.lit(action)), allowMissingColumns=True
        )
        return DigestIndex(cut_lineage(both.groupBy("shard").applyInArrow(run, self.COLUMNS)), self.shards)

    def insert(self, batch: DataFrame) -> DigestIndex:
        """Add rows (digest, copies, points, no_key, key, row); digests may repeat within and between batches."""
        return self._apply(batch, "1")

    def delete(self, batch: DataFrame) -> DigestIndex:
        """Remove digests; those that are not live are passed over."""
        return self._apply(batch.select("digest"), "2")


def dedup(frame: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per row of the frame: key, ``digest``, ``keep_key``, ``copies``, ``kept``.

    Two texts are equal if they are the same without the six ASCII white-space characters; null counts as empty. Of
    equal texts one row is kept: most code points in the text, then smallest key (null last), then any one of rows that
    agree in both. ``keep_key`` is that row's key. Copies are counted per task before digests are dealt to shards, so a
    text that fills a third of the table reaches its shard as one row per task. Other columns are not read; an empty
    table gives an empty result.
    """
    rows = cut_lineage(
        frame.select(
            F.col(key).alias("key"),
            F.sha2(normalised(F.col(text)), 256).alias("digest"),
            F.coalesce(F.length(text), F.lit(0)).cast("long").alias("points"),
            F.monotonically_increasing_id().alias("row"),
            F.spark_partition_id().alias("part"),
        )
    )
    best = F.min(F.struct((-F.col("points")).alias("lost"), F.col("key").isNull().alias("no_key"), "key", "row"))
    batch = (
        rows.groupBy("digest", "part")
        .agg(F.count(F.lit(1)).alias("copies"), best.alias("best"))
        .select("digest", "copies", (-F.col("best.lost")).alias("points"), "best.no_key", "best.key", "best.row")
    )
    index = DigestIndex.empty(frame.sparkSession, rows.count()).insert(batch)
    groups = index.rows.select(F.col("digest").alias("of"), "copies", F.col("key").alias("keep_key"), F.col("row").alias("keep_row"))
    return rows.join(groups, F.col("digest") == F.col("of")).select(
        F.col("key").alias(key), "digest", "keep_key", "copies", (F.col("row") == F.col("keep_row")).alias("kept")
    )
