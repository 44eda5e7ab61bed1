import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark():
    s = (
        SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4").config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture
def docs(spark):
    """Nulls in every column, empty and long texts, equal and repeated rows, and columns with names that clash with ours."""
    words = " ".join(f"word{i}" for i in range(400))
    rows = [
        (1, words, "a"), (2, words.replace("word200 ", "other "), "a"), (3, words, None), (4, None, "b"), (5, "", "b"), (6, "!!!", "b"), (7, "!!!", "c"), (None, words, "c"),
        (8, "mail me: jo@ex.com or +1 (743) 555-3824", "c"), (9, "x y " * 50_000, "a"), (10, "short", None), (10, "short", None),
    ]
    return spark.createDataFrame([(*r, 1, "k") for r in rows], "doc_id long, text string, source string, id int, key string")
