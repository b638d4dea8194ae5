"""Reproducible shuffle and sharding by a Feistel permutation of global row numbers."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stripgrid.functions.lineage import cut_lineage
from stripgrid.llm.common import fresh

ROUNDS = 6


def number_rows(frame: DataFrame, order: list[str], name: str = "row_number") -> tuple[DataFrame, int]:
    """Add the global rank of each row in the order of the given columns, from 0; also return the row count.

    One range shuffle spreads the rows. Equal keys may lie in several ranges (the arrival number is the last sort
    column), so a repeated key is not a hot one. Rows that agree in all order columns get neighbouring ranks in any
    order; nulls come first. Ranks do not depend on files, partitions or executors. The ranges are checkpointed: their
    borders come from a sample, which must not be drawn again between counting and numbering.
    """
    arrival, part, place, before = (fresh(frame, x) for x in ("arrival", "part", "place", "before"))
    ranged = cut_lineage(
        frame.withColumn(arrival, F.monotonically_increasing_id())
        .repartitionByRange(*order, arrival)
        .sortWithinPartitions(*order, arrival)
        .withColumns({part: F.spark_partition_id(), place: F.monotonically_increasing_id().bitwiseAND(F.lit(2**33 - 1))})
        .drop(arrival)
    )
    # One row per range: as many as shuffle partitions, whatever the number of rows.
    starts, rows = [], 0
    for index, n in sorted(tuple(x) for x in ranged.groupBy(part).count().collect()):
        starts.append((index, rows))
        rows += n
    offsets = frame.sparkSession.createDataFrame(starts, f"`{part}` int, `{before}` long")
    numbered = ranged.join(F.broadcast(offsets), part).withColumn(name, F.col(place) + F.col(before))
    return numbered.drop(part, place, before), rows


class Permutation:
    """A keyed bijection of 0 .. rows-1: a Feistel network on pairs (left < a, right < b), a * b >= rows.

    Each round adds a hash of one half to the other half, modulo that half's range. A number that lands at ``rows`` or
    above walks on along its cycle. Fewer than a numbers lie up there, and only they can prolong a walk; so the longest
    walk is measured on them alone (at most the root of the row count) and unrolled to exactly that length.
    """

    def __init__(self, spark: SparkSession, rows: int, seed: int = 0):
        self.rows, self.seed = rows, seed
        self.a = math.isqrt(max(rows - 1, 0)) + 1
        self.b = max(1, -(-rows // self.a))
        self.steps = 1 + self._longest_tail(spark)

    def _once(self, frame: DataFrame, x: str) -> DataFrame:
        left, right = fresh(frame, "left_half"), fresh(frame, "right_half")
        frame = frame.withColumns({left: F.expr(f"`{x}` div {self.b}L"), right: F.expr(f"pmod(`{x}`, {self.b}L)")})
        for turn in range(ROUNDS):
            moved, kept, size = (left, right, self.a) if turn % 2 == 0 else (right, left, self.b)
            step = f"pmod(xxhash64({int(self.seed)}L, {turn}, `{kept}`), {size}L)"
            frame = frame.withColumn(moved, F.expr(f"pmod(`{moved}` + {step}, {size}L)"))
        return frame.withColumn(x, F.expr(f"`{left}` * {self.b}L + `{right}`")).drop(left, right)

    def _longest_tail(self, spark: SparkSession) -> int:
        steps, left = 0, self.a * self.b - self.rows
        tail = spark.range(self.rows, self.a * self.b)
        while left:
            tail = self._once(tail, "id").where(F.col("id") >= self.rows)
            before, left = left, tail.count()
            if left == before:  # cycles wholly up there, which no walk from below enters
                break
            steps += 1
        return steps

    def apply(self, frame: DataFrame, source: str, name: str) -> DataFrame:
        """Add the image of a number column."""
        frame = self._once(frame.withColumn(name, F.col(source)), name)
        for _ in range(self.steps - 1):
            walked = fresh(frame, "walked")
            frame = self._once(frame.withColumn(walked, F.col(name)), walked)
            frame = frame.withColumn(name, F.when(F.col(name) < self.rows, F.col(name)).otherwise(F.col(walked))).drop(walked)
        return frame


def shard(frame: DataFrame, shards: int, order: list[str], seed: int = 0) -> DataFrame:
    """Deal shuffled rows to shards: adds ``row_number``, ``position``, ``shard`` and ``slot``.

    ``position`` is the permuted row number; shard = position mod shards, slot = position div shards. So counts differ
    by one at most, slots have no gap, and where a row goes can be computed from its number, the row count and the seed.
    Every row is dealt, rows with nulls, empty texts and repeated rows included; an empty table gives an empty result.
    A column of the frame with one of the added names is replaced.
    """
    frame = frame.drop(*[x for x in ("row_number", "position", "shard", "slot") if x not in order])
    numbered, rows = number_rows(frame, order)
    dealt = Permutation(frame.sparkSession, rows, seed).apply(numbered, "row_number", "position")
    return dealt.withColumns(
        {
            "shard": F.expr(f"cast(pmod(position, {int(shards)}L) as int)"),
            "slot": F.expr(f"position div {int(shards)}L"),
        }
    )
