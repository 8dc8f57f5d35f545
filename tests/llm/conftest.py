import pytest


@pytest.fixture(scope="session")
def labels(spark):
    """Ids 0 to 79: every fourth of low quality, every fifth toxic."""
    return spark.createDataFrame([(i, int(i % 4 != 0), int(i % 5 == 0)) for i in range(80)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls, an empty text, a repeated row, a long text and columns whose names the operators use."""
    rows = [
        (1, None, "en"), (2, "", "en"), (3, "one two three", None), (4, "One TWO three", "en"), (4, "One TWO three", "en"),
        (None, "a text without an id but with some words", "de"), (5, "long " * 20_000 + "end", "fr"), (6, "\n \t ", "es"), (7, "ünïcode 漢字 \U0001f600 text", "en"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    return df.selectExpr("*", "1 AS n", "'x' AS row_hash", "2 AS label", "3 AS words", "4 AS `key`", "5 AS score", "6 AS part")
