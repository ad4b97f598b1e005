"""Every named query against its SQL twin, over the whole tables."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from oracle.statements import STATEMENTS
from tallyhouse.catalogue import QUERIES
from tests.comparing import differences, duck
from tests.conftest import SMALL


@pytest.fixture(scope="module")
def con():
    return duck(SMALL)


def test_every_query_has_sql():
    assert set(QUERIES) == set(STATEMENTS)


@pytest.mark.parametrize("name", list(QUERIES))
def test_matches_sql(spark, con, name):
    assert differences(queries()[name](spark, SMALL), con.sql(oracle_sql()[name])) == []


def test_entry(spark):
    assert entry(spark).count() == 5
