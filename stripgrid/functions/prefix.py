"""Running totals over a directory (one row per strip or block) without a single-task window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BUCKET = 4096


def running_start(directory: DataFrame, order: str, size: str, start: str) -> DataFrame:
    """Add ``start``: the sum of ``size`` over all rows with a smaller ``order`` (a unique integer).

    Window inside each bucket of consecutive ids, plus the bucket's own offset. Only the list of buckets,
    4096 times shorter than the directory, goes through one task.
    """
    bucketed = directory.withColumn("_bucket", F.floor(F.col(order) / BUCKET).cast("bigint"))
    inside = Window.partitionBy("_bucket").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = (
        bucketed.groupBy("_bucket")
        .agg(F.sum(size).alias("_total"))
        .select("_bucket", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_offset"))
    )
    local = bucketed.withColumn("_inside", F.coalesce(F.sum(size).over(inside), F.lit(0)))
    return (
        local.join(totals, "_bucket")
        .withColumn(start, (F.col("_offset") + F.col("_inside")).cast("bigint"))
        .drop("_bucket", "_inside", "_offset")
    )
