"""A training corpus from raw documents: five stages, each on all that its predecessor kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stripgrid.functions.lineage import ensure_checkpoint_dir
from stripgrid.llm import queries
from stripgrid.llm.jaccard import keep_one
from stripgrid.llm.language import UNKNOWN, fit, identify
from stripgrid.llm.lines import dedup_lines
from stripgrid.llm.mixing import mix, take
from stripgrid.llm.packing import pack


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language; those without a letter, or whose n-grams no language knows, go.

    A document whose label is missing gets the predicted language.
    """
    model = fit(docs.where(~queries.held_out()))
    found = identify(docs, model).where((F.col("lang_pred") != UNKNOWN) & (F.col("score") > 0))
    return found.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated lines; those of which nothing is left go."""
    cleaned = dedup_lines(docs).where(F.trim(F.coalesce("text", F.lit(""))) != "")
    return cleaned.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar texts."""
    return keep_one(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return take(mix(docs, F.regexp_count("text", F.lit(queries.WORDS))), docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences, as pieces of documents."""
    return queries.digest(pack(docs, "doc_id", "text", public_tokenizers.path(queries.TOKENIZER), queries.WINDOW))


STAGES = [
    ("language", language),
    ("lines", lines),
    ("near_duplicates", near_duplicates),
    ("mixing", mixing),
    ("packing", packing),
]

# Language scores, SimHash groups, random rounding and token ids have no SQL form; tests compare brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder as Parquet and read again."""
    import uuid

    folder = f"{ensure_checkpoint_dir(spark)}/corpus-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
