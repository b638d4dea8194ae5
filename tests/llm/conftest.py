import pandas as pd
import pytest

LONG = " ".join(f"word{i}" for i in range(60_000))


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows and clashing extra columns."""
    rows = [
        (1, "one two three four five six\nseven eight nine ten eleven twelve", "en", "a"),
        (1, "one two three four five six\nseven eight nine ten eleven twelve", "en", "a"),
        (2, None, "en", "a"),
        (3, "", None, None),
        (None, "one two three four five six\nseven eight nine ten eleven twelve", "en", None),
        (None, None, None, None),
        (4, LONG, "en", "b"),
        (5, "   \n\t\n ", "de", "b"),
        (6, "!!! 123", "de", "b"),
        (7, "a", "fr", "c"),
    ]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    for name in ("size", "row_id", "node", "bucket", "shard", "score", "key", "target", "unit_id", "gone"):
        frame = frame.selectExpr("*", f"'clash' as `{name}`")
    return frame


@pytest.fixture(scope="session")
def no_documents(odd_documents):
    return odd_documents.where("false")


@pytest.fixture(scope="session")
def documents(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet")


def pandas(frame) -> pd.DataFrame:
    return frame.toPandas()
