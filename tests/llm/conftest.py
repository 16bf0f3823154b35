import pytest

from tidegauge.session import ship_package


@pytest.fixture(scope="session", autouse=True)
def shipped(spark):
    ship_package(spark)


@pytest.fixture
def docs(spark):
    """Rows of ``(doc_id, text)`` as documents, with columns whose names operators use themselves."""

    def build(*rows):
        frame = spark.createDataFrame(list(rows), "doc_id LONG, text STRING")
        return frame.selectExpr("*", "'x' AS score", "1 AS n_words", "'y' AS node", "2 AS shard", "3 AS words", "4 AS kept")

    return build
