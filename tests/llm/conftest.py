import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]").appName("pulseframe-llm-tests")
        .config("spark.sql.shuffle.partitions", "4").config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false").config("spark.driver.memory", "4g").getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    yield session


SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls, empty and long texts, ties, repeated rows and clashing names."""
    passage = " ".join(f"w{i}" for i in range(40))
    rows = [
        (1, passage + " one tail", "n1"), (2, "start " + passage, "n2"), (2, "start " + passage, "n2"),
        (3, None, None), (None, passage, "n4"), (4, "", "n5"), (5, " \n\t ", "n6"), (6, "a b", "n7"), (7, "A  b", "n8"),
        (8, "x " * 30000, "n9"), (9, passage.upper() + " one tail", "n10"), (10, "é ü z 日本", "n11"),
        (11, "line one\nline one\n\n\nline one \nend", "n12"), (12, "y" * 50000, "n13")]
    return spark.createDataFrame(rows, "doc_id long, text string, n_words string")
