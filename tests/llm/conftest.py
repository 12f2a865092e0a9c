import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, chunk string, bucket string"


def rows_of(texts, first=0):
    return [(first + i, t, "en", f"s{i % 3}", len(t or ""), "clash", None) for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def documents(spark):
    """Builds a documents table (with extra clashing columns) from texts."""
    return lambda texts, first=0: spark.createDataFrame(rows_of(texts, first), SCHEMA)


@pytest.fixture(scope="session")
def sample(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


ODD = [None, "", " \n\t ", "one", "two words", "é" * 3000 + " ß" * 500, "same text here", "same text here", "a\x00b c d e f g", "1" * 30000, "- " * 9000, "x" * 40000]


@pytest.fixture(scope="session")
def odd_texts():
    return list(ODD)
