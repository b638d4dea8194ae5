"""The operators as queries over the given tables, with the same results in SQL where SQL can express them."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stripgrid.functions.lineage import ensure_checkpoint_dir
from stripgrid.llm.common import table
from stripgrid.llm.dedup import dedup
from stripgrid.llm.html import main_text
from stripgrid.llm.jaccard import similar
from stripgrid.llm.language import fit, identify
from stripgrid.llm.licenses import scan_licenses
from stripgrid.llm.lines import dedup_lines
from stripgrid.llm.mixing import mix
from stripgrid.llm.negatives import hard_negatives
from stripgrid.llm.neighbours import nearest
from stripgrid.llm.packing import pack
from stripgrid.llm.sharding import shard
from stripgrid.llm.spelling import spelling_variants
from stripgrid.llm.tokens import token_counts

SHARDS = 16
WINDOW = 2048
TOKENIZER = "byte_bpe_50k.json"
COUNTING_TOKENIZER = "word_bpe_49k.json"
WORDS = r"[^\x20\x09-\x0D]+"


def held_out(key: str = "doc_id"):
    """Rows whose language is never learned from."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))) % 4 == 2


def op1_sharding(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "documents").select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"),
    )
    dealt = shard(rows, SHARDS, ["doc_id", "text_crc32", "size"])
    return dealt.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "row_number",
    )


def op2_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return similar(table(spark, folder, "documents"))[0].drop("row_id")


def op3_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return scan_licenses(table(spark, folder, "documents"))


def op4_language_id(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    model = fit(documents.where(~held_out()))
    return identify(documents.select("doc_id", held_out().alias("held_out"), "text"), model).drop("text")


def op5_packing(spark: SparkSession, folder: str) -> DataFrame:
    return digest(pack(table(spark, folder, "documents"), "doc_id", "text", public_tokenizers.path(TOKENIZER), WINDOW))


def digest(pieces: DataFrame) -> DataFrame:
    """Pieces with the CRC of their ids in place of the ids."""
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def op6_main_text(spark: SparkSession, folder: str) -> DataFrame:
    found = main_text(table(spark, folder, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "host")


def op7_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = dedup(table(spark, folder, "documents"))
    return found.select(
        "doc_id",
        F.col("keep_key").alias("keep_id"),
        F.col("copies").alias("group_size"),
        "kept",
        F.col("digest").alias("text_sha256"),
    )


def op8_nearest(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings")
    return nearest(vectors.where("vec_id % 50 = 0"), vectors)


def op9_mixing(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select("doc_id", "text", "source")
    mixed = mix(documents, F.regexp_count("text", F.lit(WORDS)))
    return mixed.select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source"
    )


def op10_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return dedup_lines(table(spark, folder, "documents").select("doc_id", "text"))


def op11_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings")
    label = F.expr("case when vec_id % 7 = 0 then (cast(label as long) + 1) % 10 else label end")
    return hard_negatives(vectors, F.expr("vec_id % 100 = 0"), label)


def op12_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    return spelling_variants(table(spark, folder, "documents"))


def op13_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Each call starts with an empty cache, so that its work covers the whole table."""
    cache = f"{ensure_checkpoint_dir(spark)}/token-counts-{uuid.uuid4().hex}"
    path = public_tokenizers.path(COUNTING_TOKENIZER)
    counts = token_counts(table(spark, folder, "documents"), "doc_id", "text", path, cache)
    return counts.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > WINDOW).alias("over_limit"))


def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    from corpus_pipeline import run

    return run(spark, folder)


QUERIES = {
    "op1_sharding": op1_sharding,
    "op2_jaccard_join": op2_jaccard_join,
    "op3_license_scan": op3_license_scan,
    "op4_language_id": op4_language_id,
    "op5_packing": op5_packing,
    "op6_main_text": op6_main_text,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_nearest": op8_nearest,
    "op9_mixing": op9_mixing,
    "op10_line_dedup": op10_line_dedup,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_token_counts": op13_token_counts,
    "pipeline": pipeline,
}

ORACLES = {
    "op7_exact_dedup": r"""
        WITH t AS (
            SELECT doc_id, length(coalesce(text, '')) AS points,
                   sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
            FROM documents)
        SELECT doc_id,
               first_value(doc_id) OVER w AS keep_id,
               count(*) OVER (PARTITION BY text_sha256) AS group_size,
               row_number() OVER w = 1 AS kept,
               text_sha256
        FROM t
        WINDOW w AS (PARTITION BY text_sha256 ORDER BY points DESC, doc_id)
    """,
    "op11_hard_negatives": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e,
                   CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label END AS label
            FROM embeddings
            WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (
            SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same,
                   list_inner_product(a.e, c.e)::BIGINT AS score
            FROM v AS a JOIN v AS c ON a.vec_id <> c.vec_id
            WHERE a.vec_id % 100 = 0),
        p AS (
            SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
            QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
        SELECT p.anchor_id, positive_id,
               row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id)::INTEGER AS rank,
               vec_id AS negative_id, positive_score, score AS negative_score
        FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same
          AND 100 * score BETWEEN 30 * positive_score AND 90 * positive_score
        QUALIFY rank <= 10
    """,
}
