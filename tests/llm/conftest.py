import pytest
from pyspark.sql import functions as F

#: Columns whose names operators use inside; documents may have them too.
CLASHING = ("size", "target", "repeats", "features", "keys", "class", "point", "id", "component_id", "n_words", "kept", "__row", "__gone", "__text", "__key", "__times", "__occurrence", "__id", "__text_key", "__spans", "__source", "__hash", "__size", "__s", "__k", "whole", "hash_upto", "source_size", "piece_ids", "doc", "root", "node")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty, blank and very long texts, repeated rows, ties and columns with clashing names."""
    long = " ".join(f"w{k % 977}x{k}" for k in range(60_000))
    rows = [
        (1, None, "en", "a"),
        (2, "", "en", "a"),
        (3, " \t\n ", None, "b"),
        (4, "word", "en", None),
        (None, "a row without an id has a text of its own here", "en", "a"),
        (5, long, "en", "b"),
        (6, "the same text stands in two rows of this table and is long enough to count as one", "en", "c"),
        (7, "the same text stands in two rows of this table and is long enough to count as one", None, None),
        (7, "the same text stands in two rows of this table and is long enough to count as one", None, None),
        (8, long, None, "c"),
        (9, "zzzz" * 20_000, "de", "c"),
    ]
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    return docs.withColumns({c: F.lit(7) for c in CLASHING})


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("false")


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
