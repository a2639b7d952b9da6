import pytest

from quaver.session import local_session


@pytest.fixture(scope="session")
def spark():
    return local_session(4, "quaver-tests")


@pytest.fixture
def rows(spark):
    def make(data, schema):
        return spark.createDataFrame(data, schema)

    return make


@pytest.fixture
def one(spark):
    """Value of a column expression of one text."""

    def value(expression, text="x"):
        return spark.createDataFrame([(text,)], "text STRING").select(expression).first()[0]

    return value
