import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, _key string"


@pytest.fixture(scope="session")
def odd(spark):
    """Rows that every operator has to take: nulls, empty and very long texts, repeated rows, ties, extra columns with names that operators use."""
    words = [f"w{i % 97}x{i % 13}" for i in range(30_000)]
    rows = [
        (1, None, None, None, None),
        (2, "", "en", "a", 0),
        (3, " \t\n ", "en", "a", 4),
        (4, "one two three", "en", "b", 13),
        (5, "x" * 5_000, "en", None, 5_000),
        (6, " ".join(words), "de", "b", None),
        (7, " ".join(words), "de", "b", 1),
        (7, " ".join(words), "de", "b", 1),
        (None, "no id at all but some words in a row that could repeat here", "fr", "c", 60),
        (8, "no id at all but some words in a row that could repeat here", "fr", "c", 60),
        (9, "Größe 日本語 😀 <|endoftext|> password = hunter22 é" + " tail" * 30, "ja", "", 3),
    ]
    return spark.createDataFrame([(*r, 1, "k") for r in rows], SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
