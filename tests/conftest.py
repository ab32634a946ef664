import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]").appName("pulseframe-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def lines(spark):
    """Lines table from ``{file: [text, ...]}``."""
    def make(files):
        rows = [(name, i, text) for name, texts in files.items() for i, text in enumerate(texts)]
        return spark.createDataFrame(rows, "source_file STRING, line_no BIGINT, value STRING")
    return make
