"""Language identification by bit-sliced Bloom filters over character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stripgrid.functions.lineage import cut_lineage

GRAM = 4
HASHES = 3
UNKNOWN = "und"
BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def letter_table() -> np.ndarray:
    return np.fromiter((chr(x).isalpha() for x in range(0x110000)), bool, 0x110000)


def grams(text: str, letters: np.ndarray) -> np.ndarray:
    """A 64-bit hash for each n-gram of the lower-case text, where runs of other characters are one space."""
    codes = np.frombuffer((" " + text.lower() + " ").encode("utf-32-le", "surrogatepass"), "<u4")
    codes = np.where(letters[codes], codes, 32)
    space = codes == 32
    codes = codes[~(space & np.concatenate(([False], space[:-1])))].astype(np.uint64)
    if len(codes) < 3:
        return np.zeros(0, np.uint64)
    codes = np.concatenate((codes, np.full(max(0, GRAM - len(codes)), 32, np.uint64)))
    width, hashed = len(codes) - GRAM + 1, np.zeros(len(codes) - GRAM + 1, np.uint64)
    for i in range(GRAM):
        hashed = (hashed + codes[i : i + width]) * np.uint64(0x9E3779B97F4A7C15)
        hashed ^= hashed >> np.uint64(29)
    return hashed


def slots(hashed: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """The filter positions of each n-gram; the size is a power of two."""
    second = (hashed >> np.uint64(32)) | np.uint64(1)
    for i in range(HASHES):
        yield ((hashed + np.uint64(i) * second) & np.uint64(size - 1)).astype(np.int64)


@dataclass
class LanguageModel:
    """One Bloom filter per language, sliced by bits: a row per position, a bit per language."""

    languages: list[str]  # the most frequent first
    filters: np.ndarray  # positions x bytes

    @classmethod
    def empty(cls, languages: list[str], size: int) -> LanguageModel:
        return cls(languages, np.zeros((size, max(1, -(-len(languages) // 8))), np.uint8))

    def add(self, language: int, hashed: np.ndarray) -> None:
        for place in slots(hashed, len(self.filters)):
            self.filters[place, language >> 3] |= np.uint8(1 << (language & 7))

    def false_rates(self) -> np.ndarray:
        """How often an n-gram that a language lacks is found all the same: its share of set bits, once per hash."""
        share = np.concatenate([BITS[self.filters[:, b]].mean(0) for b in range(self.filters.shape[1])])
        return share[: len(self.languages)] ** HASHES

    def popcounts(self, hashed: np.ndarray) -> np.ndarray:
        """For each language, how many of the n-grams its filter holds: one lookup serves all languages."""
        found = None
        for place in slots(hashed, len(self.filters)):
            found = self.filters[place] if found is None else found & self.filters[place]
        counts = [np.bincount(found[:, b], minlength=256) @ BITS for b in range(found.shape[1])]
        return np.concatenate(counts)[: len(self.languages)]

    def predict(self, text: str | None, letters: np.ndarray, false: np.ndarray) -> tuple[str, float]:
        hashed = grams(text or "", letters)
        if not len(hashed) or not self.languages:
            return UNKNOWN, 0.0
        share = np.maximum(0.0, (self.popcounts(hashed) / len(hashed) - false) / np.maximum(1e-9, 1.0 - false))
        best = int(share.argmax())
        return self.languages[best], float(share[best] / share.sum()) if share.sum() else 0.0


def fit(
    labelled: DataFrame,
    text: str = "text",
    lang: str = "lang",
    sample_rows: int = 4000,
    grams_per_language: int = 30_000,
    least_share: float = 0.01,
    filter_size: int = 2**19,
) -> LanguageModel:
    """Learn from about ``sample_rows`` rows of each language, drawn by a hash of the text (all, if there are fewer).

    A language's filter gets its most frequent n-grams: those in at least ``least_share`` of its sampled texts, and
    in at least a fifth of the share they have in any other language, so that mislabelled rows teach nothing. Rows
    without text or label are left out. What reaches the driver is bounded by ``grams_per_language`` per language. No
    labelled rows give a model without languages, which predicts ``und``.
    """
    rows = labelled.select(F.col(text).alias("text"), F.col(lang).alias("lang")).dropna()
    counts = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").collect()
    languages, total = [x["lang"] for x in counts], {x["lang"]: x["count"] for x in counts}
    model = LanguageModel.empty(languages, filter_size)
    if not languages:
        return model
    odds = F.create_map(*[F.lit(x) for k in languages for x in (k, min(1.0, sample_rows / total[k]))])
    drawn = rows.where(F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < odds[F.col("lang")] * 1_000_000)

    def texts_with(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        letters = letter_table()
        for batch in batches:
            for name, part in batch.groupby("lang"):
                found = [np.unique(grams(x, letters)) for x in part["text"]]
                each, n = np.unique(np.concatenate(found), return_counts=True)
                yield pd.DataFrame({"lang": name, "gram": each.view(np.int64), "n": n})
                yield pd.DataFrame({"lang": [name], "gram": [None], "n": [len(part)]})

    seen = cut_lineage(
        drawn.mapInPandas(texts_with, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    )
    sizes = seen.where("gram is null").select("lang", F.col("n").alias("texts"))
    shares = seen.where("gram is not null").join(F.broadcast(sizes), "lang").withColumn("share", F.col("n") / F.col("texts"))
    top = shares.groupBy("gram").agg(F.max("share").alias("top"))
    kept = (
        shares.where(F.col("share") >= least_share)
        .join(top, "gram")
        .where(F.col("share") >= F.col("top") / 5)
        .selectExpr("lang", "gram", "share", "row_number() over (partition by lang order by share desc, gram) as place")
        .where(F.col("place") <= grams_per_language)
        .select("lang", "gram")
        .toPandas()
    )
    for index, name in enumerate(languages):
        model.add(index, kept.loc[kept["lang"] == name, "gram"].to_numpy(np.int64).view(np.uint64))
    return model


def predict(text: Column, model: LanguageModel) -> Column:
    """A struct (lang_pred, score) for each text, read whole.

    ``score`` is the winner's part of all languages' corrected shares. Null texts and texts without a letter are
    ``und`` with score 0; letters that no filter knows give the most frequent language with score 0. Only the text
    matters, so repeated rows agree.
    """
    @F.pandas_udf("lang_pred string, score double")
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        letters, false = letter_table(), model.false_rates()
        for batch in texts:
            yield pd.DataFrame([model.predict(x, letters, false) for x in batch], columns=["lang_pred", "score"])

    return of(text)


def identify(frame: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """The frame with ``lang_pred`` and ``score``; columns of these names are replaced."""
    rest = [F.col(f"`{x}`") for x in frame.columns if x.lower() not in ("lang_pred", "score")]
    return frame.select(*rest, predict(F.col(text), model).alias("found")).select(*rest, "found.lang_pred", "found.score")
