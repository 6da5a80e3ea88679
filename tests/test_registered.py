"""Every registered query against its reference SQL, on the smallest tables."""

import pytest

import __spark_entry__ as entry
from checks.compare import connect, differences

FOLDER = "/root/testdata/sf0.001"
QUERIES = entry._own_queries()
STATEMENTS = {k: v for k, v in entry.oracle_sql().items() if k in QUERIES}


@pytest.fixture(scope="module")
def db():
    return connect(FOLDER)


def test_every_statement_has_a_query():
    assert set(STATEMENTS) <= set(QUERIES)
    assert set(QUERIES) == set(STATEMENTS)


@pytest.mark.parametrize("name", sorted(STATEMENTS))
def test_same_rows_as_the_reference_sql(spark, db, name):
    assert differences(QUERIES[name](spark, FOLDER), db.execute(STATEMENTS[name])) == []


def test_flagship(spark):
    assert entry.entry(spark).count() > 0
