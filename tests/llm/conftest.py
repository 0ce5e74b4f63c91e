import os

import pytest

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

# null and empty texts, one word, a very long text, repeated rows, ties, a null id
LONG = " ".join(f"word{i % 977} of{i}" for i in range(60_000))
ODD = [
    (1, None, "en", "a"),
    (2, "", "en", "a"),
    (3, "one", None, None),
    (4, "One", "en", None),
    (5, LONG, "en", "b"),
    (6, "  \n\t \n", "en", "b"),
    (7, "repeated row", "en", "c"),
    (7, "repeated row", "en", "c"),
    (None, "no id here", "en", "c"),
    (8, "123 456 !!", "en", "c"),
]
SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.fixture()
def odd(spark):
    """Odd rows, with extra columns whose names operators use themselves."""
    df = spark.createDataFrame(ODD, SCHEMA)
    for name in ("id", "row", "n", "mark", "kept", "score", "bucket", "site", "topic"):
        df = df.selectExpr("*", f"'x' AS {name}")
    return df


@pytest.fixture()
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def texts():
    import duckdb

    return duckdb.sql(f"SELECT doc_id, text, lang, source FROM '{os.path.join(SF, 'documents.parquet')}' ORDER BY doc_id").fetchall()


@pytest.fixture()
def docs(spark, texts):
    return spark.createDataFrame(texts, SCHEMA).repartition(5)
