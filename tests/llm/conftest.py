import pytest


@pytest.fixture(scope="session")
def make(spark):
    """A DataFrame from rows and a schema."""
    return lambda rows, schema: spark.createDataFrame(rows, schema)
