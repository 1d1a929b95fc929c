"""Every registered query beside its SQL, on the smallest tables."""

import pytest
from compare import compare, connect

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
QUERIES, ORACLE = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


def test_every_sql_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    problems, rows, _ = compare(spark, con, FOLDER, name, QUERIES[name], ORACLE.get(name))
    assert rows >= 0
    assert not problems, "\n".join(problems)


def test_entry_runs(spark):
    assert entry.entry(spark).count() == 150
