import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "word " * 60_000 + "end"
ROWS = [
    (1, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen", "en", "a", 1),
    (2, None, None, None, None),
    (3, "", "en", None, 0),
    (4, LONG, "en", "a", 300_003),
    (5, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen", "en", "a", 1),
    (5, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen", "en", "a", 1),
    (None, "mail joe@example.com or +1 (212) 555-0199 " * 3, "en", "a", 1),
    (7, " \t\n\u000b\f\r ", "xx", "b", 7),
    (8, "naïve ÄÖÜ 漢字 🙂 é " * 20, "fr", "b", 7),
    (9, "x", "en", "a", 1),
]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
