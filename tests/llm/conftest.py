import pytest
from llm_cases import CLASHING, ODD, SCHEMA


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with every kind of odd row."""
    rows = [(*row, len(row[1] or "")) for row in ODD]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def clashing(spark, odd):
    """The same with extra columns named like those the operators work with."""
    return odd.selectExpr("*", *(f"'x' AS `{name}`" for name in CLASHING))


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture
def make(spark):
    """Documents from texts, numbered from 0."""

    def documents(*texts, source="a", lang="en"):
        rows = [(i, t, lang, source, len(t or "")) for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, SCHEMA)

    return documents
