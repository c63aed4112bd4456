import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls in every column, empty and long texts, repeated rows, and extra columns with clashing names."""
    long = "the quick brown fox jumps over the lazy dog again and again " * 4000
    rows = [
        (1, "A b c d e f g h i j k l", "en", "s", 23),
        (1, "A b c d e f g h i j k l", "en", "s", 23),
        (2, None, None, None, None),
        (3, "", "en", "s", 0),
        (None, "a b c d e f g h i j k l", "fr", None, 23),
        (4, long, "en", "s", len(long)),
        (5, " \t\n ", "en", "s", 4),
        (6, "\U0001f600 \x00 é ß İ ﬁ 12", "de", "s", 12),
        (7, "word", None, "t", 4),
    ]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    extra = {c: "x" for c in ("n_words", "score", "shard", "size", "spans", "digest", "_row", "n_shingles", "weight")}
    return frame.selectExpr("*", *(f"'{v}' as {k}" for k, v in extra.items()))


@pytest.fixture(scope="session")
def no_documents(odd_documents):
    return odd_documents.limit(0)
