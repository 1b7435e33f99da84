"""Every registered query against its SQL."""

import pytest

import __spark_entry__ as registered
import compare

FOLDER = "/root/testdata/sf0.01"
STATEMENTS = {name: sql for name, sql in registered.oracle_sql().items() if name in registered.QUERIES}


@pytest.fixture(scope="module")
def database():
    return compare.open_database(FOLDER)


@pytest.fixture(scope="module")
def tables(spark):
    """The queries share written attempts and sessions here; compare.py runs each from the raw tables."""
    return registered.Tables(spark, FOLDER).store()


@pytest.mark.parametrize("name", sorted(STATEMENTS))
def test_query_equals_sql(tables, database, name):
    ours = registered.rounded(registered.QUERIES[name](tables))
    assert compare.difference(ours, database.sql(STATEMENTS[name])) is None


@pytest.mark.parametrize("name", ["attempts_typed", "sessions", "insight_evidence", "customer_analytics"])
def test_query_from_raw_tables(spark, database, name):
    ours = registered.queries()[name](spark, FOLDER)
    assert compare.difference(ours, database.sql(STATEMENTS[name])) is None


def test_every_statement_has_a_query():
    assert set(registered.oracle_sql()) <= set(registered.queries())
    assert set(registered.QUERIES) - set(STATEMENTS) == {"merchant_context"}


def test_context_documents(tables):
    assert registered.QUERIES["merchant_context"](tables).count() == 25


def test_entry(spark):
    result = registered.entry(spark)
    assert result.columns[0] == "merchant_key" and result.count() == 25
