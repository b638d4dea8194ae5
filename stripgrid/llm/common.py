"""Small helpers that the operators share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stripgrid.functions.lineage import ensure_checkpoint_dir

WHITE = "\x20\x09\x0a\x0b\x0c\x0d"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def fresh(frame: DataFrame, name: str) -> str:
    """A column name that the frame does not use yet (names are compared without case, as Spark does)."""
    taken = {column.lower() for column in frame.columns}
    while name.lower() in taken:
        name += "_"
    return name


def total(value: Column) -> Column:
    """Sum of longs that gives 0 for no rows."""
    return F.coalesce(F.sum(value), F.lit(0)).cast("long")


def unit(*parts: Column) -> Column:
    """A number in [0, 1) that depends on the parts only."""
    return F.pmod(F.xxhash64(*parts), F.lit(2**48)) / F.lit(float(2**48))


def stored(frame: DataFrame) -> DataFrame:
    """The frame, written to the shared folder and read again, for what a loop carries from round to round.

    A checkpoint keeps the optimizer's size estimate, which each join multiplies; over the rounds of a loop it grows to
    a number of millions of digits, which costs the driver time and memory. A written table has the size of its files.
    """
    folder = f"{ensure_checkpoint_dir(frame.sparkSession)}/stored-{uuid.uuid4().hex}"
    frame.write.parquet(folder)
    return frame.sparkSession.read.schema(frame.schema).parquet(folder)
