"""Every registered query against its expected result, on the smallest tables."""

import pytest

import __spark_entry__ as entry
from breachlens import registry
from check import actual, connect, difference, expected
from tests.small import settings

DIRECTORY = "/root/testdata/sf0.001"


@pytest.fixture(scope="module", autouse=True)
def compiled(spark):
    """As outside of tests."""
    with settings(spark, {
        "spark.sql.codegen.wholeStage": "true", "spark.sql.codegen.factoryMode": "FALLBACK",
    }):
        yield


@pytest.fixture(scope="module")
def db():
    return connect(DIRECTORY)


def test_every_query_has_an_expected_result():
    assert set(registry.queries()) <= set(entry.oracle_sql())
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, db, name):
    got = actual(entry.queries()[name](spark, DIRECTORY))
    assert difference(got, expected(db, entry.oracle_sql()[name])) is None


def test_entry(spark):
    assert entry.entry(spark).limit(1).count() == 1
