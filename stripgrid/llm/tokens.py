"""Token counts behind a cache of digests: only texts that no earlier count covers are encoded."""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stripgrid.llm.common import WHITE, stored

BATCH = 256
MEMO = 2**19
LONG_WORD = 256
FEW = 50_000
CACHE = "tokenizer string, digest binary, n_tokens long"

# The split pattern of word-level byte BPE files, none of whose matches holds white space.
WORD_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def version_of(path: str) -> str:
    """Digest of the tokenizer file: counts of another file are never used."""
    with open(path, "rb") as file:
        return hashlib.file_digest(file, "sha256").hexdigest()


def skips_white_space(path: str) -> bool:
    """Whether the count of a text is the sum over its words, however they are spaced.

    So it is when white space ends every match of the split pattern and is dropped, special tokens hold none and do not
    reach for it, and normalisation never joins across it (NFC and lower case do not).
    """
    if not path.endswith(".json"):
        return False
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    normalizer, pre = spec.get("normalizer") or {}, spec.get("pre_tokenizer") or {}
    steps = normalizer.get("normalizers", [normalizer] if normalizer else [])
    spaces = {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}
    first, *then = pre.get("pretokenizers", [{}])
    return (
        all(x.get("type") in ("NFC", "Lowercase") or x == spaces for x in steps)
        and first.get("type") == "Split"
        and first.get("pattern") == {"Regex": WORD_SPLIT}
        and (first.get("behavior"), first.get("invert")) == ("Removed", True)
        and all(x.get("type") == "ByteLevel" and not x.get("use_regex") and not x.get("add_prefix_space") for x in then)
        and spec["model"].get("type") == "BPE"
        and not spec["model"].get("dropout")
        and not any(x["lstrip"] or x["rstrip"] or x["single_word"] or set(x["content"]) & set(WHITE) for x in spec.get("added_tokens", []))
    )


def content(text: Column, by_words: bool) -> Column:
    """What a digest stands for: the text, with each run of white space as one space where counts don't depend on it."""
    text = F.coalesce(text, F.lit(""))
    return F.trim(F.regexp_replace(text, "[\\x20\\x09-\\x0D]+", " ")) if by_words else text


def digest(text: Column, by_words: bool) -> Column:
    return F.unhex(F.sha2(content(text, by_words), 256))


def kept_model(library, path: str, load):
    """One model per file and Python worker. Loading anew in each task costs time, and a dropped one does not give all of
    its memory back; the library's module outlives tasks, the globals of functions that travel with them do not."""
    kept = vars(library).setdefault("_kept_models", {})
    if path not in kept:
        kept[path] = load(path)
    return kept[path]


class Counter:
    """Token counts inside a task. Where counts add up over words, the library sees each word of a task once."""

    def __init__(self, path: str, by_words: bool):
        self.by_words = by_words
        self.memo: dict[bytes, int] = {}
        if path.endswith(".model"):
            import sentencepiece

            model = kept_model(sentencepiece, path, lambda file: sentencepiece.SentencePieceProcessor(model_file=file))
            self.encode = lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
        else:
            import tokenizers

            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            model = kept_model(tokenizers, path, tokenizers.Tokenizer.from_file)
            model.no_truncation()
            model.no_padding()
            self.encode = lambda texts: [len(x) for x in model.encode_batch_fast(texts, add_special_tokens=False)]

    def counts(self, texts: list[str]) -> list[int]:
        if not self.by_words:
            return self.encode(texts)
        split = [x.encode().split() for x in texts]  # bytes split at the ASCII white space of ``content``
        new = list({word for words in split for word in words if word not in self.memo})
        self.memo.update(zip(new, self.encode([x.decode() for x in new])))
        out = [sum(map(self.memo.__getitem__, words)) for words in split]
        if len(self.memo) > MEMO:
            self.memo.clear()
        for word in new:
            if len(word) > LONG_WORD:
                self.memo.pop(word, None)
        return out


def read_cache(spark: SparkSession, folder: str, version: str) -> DataFrame:
    """(digest, n_tokens) of one tokenizer. Two jobs may have added the same digest; its counts are equal."""
    rows = spark.read.schema(CACHE).parquet(folder).where(F.col("tokenizer") == version)
    return rows.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def token_counts(frame: DataFrame, key: str, text: str, tokenizer_path: str, cache: str) -> DataFrame:
    """(key, n_bytes, n_tokens, digest) per row: tokens of the whole text as the tokenizer's library counts them, without added
    begin and end tokens; special strings in a text count as the library's default says.

    ``cache`` is a folder that all executors share, made if missing: a table (tokenizer, digest, n_tokens) of earlier counts. A
    text's digest is the SHA-256 of its normalised content (``content``); rows are looked up by it and by the digest
    of the tokenizer file. Each distinct text that is missing is encoded once and its count appended; a later call with the
    same cache encodes nothing but new texts. Files ``.json`` run in ``tokenizers``, ``.model`` in ``sentencepiece``.

    Null counts as empty, an empty text has 0 tokens. Repeated rows come back as often as they are there, null keys too;
    other columns are not read; an empty table gives no rows. A text that fills much of the table is merged inside
    each task before it moves, and its count is handed out per input partition, so no task sees all of its rows.
    """
    spark, by_words, version = frame.sparkSession, skips_white_space(tokenizer_path), version_of(tokenizer_path)
    spark.createDataFrame([], CACHE).write.partitionBy("tokenizer").mode("append").parquet(cache)
    rows = stored(
        frame.select(
            F.col(key).alias("key"),
            F.octet_length(F.coalesce(text, F.lit(""))).cast("long").alias("n_bytes"),
            digest(F.col(text), by_words).alias("digest"),
            F.spark_partition_id().alias("part"),
        )
    )
    spots = rows.select("digest", "part").distinct()
    missing = stored(spots.select("digest").distinct().join(read_cache(spark, cache, version), "digest", "left_anti"))
    wanted = missing.count()
    if wanted:
        texts = frame.select(digest(F.col(text), by_words).alias("digest"), F.coalesce(text, F.lit("")).alias("text"))
        if wanted <= FEW:  # at most 50,000 digests of 32 bytes: few misses leave the scan, the others never move
            texts = texts.join(F.broadcast(missing), "digest", "left_semi")
        texts = texts.groupBy("digest").agg(F.first("text").alias("text"))
        if wanted > FEW:
            texts = texts.join(missing, "digest", "left_semi")  # dealt by digest already

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            counter = Counter(tokenizer_path, by_words)
            for batch in batches:
                for at in range(0, batch.num_rows, BATCH):
                    part = batch.slice(at, BATCH)
                    counts = counter.counts(part.column(1).to_pylist())
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts, pa.int64())], ["digest", "n_tokens"])

        new = texts.select("digest", "text").mapInArrow(count, "digest binary, n_tokens long")
        new.withColumn("tokenizer", F.lit(version)).write.partitionBy("tokenizer").mode("append").parquet(cache)
    counts = spots.join(read_cache(spark, cache, version), "digest")
    found = rows.join(counts, ["digest", "part"], "left")
    known = F.coalesce("n_tokens", F.raise_error(F.lit("a text is missing in the token cache")).cast("long"))
    return found.select(F.col("key").alias(key), "n_bytes", known.alias("n_tokens"), "digest")
