"""Every registered query against its SQL on the smallest tables."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from docloom.plans.oracles import SQL as OWN_SQL
from docloom.plans.queries import QUERIES
from tests.checking import compare, connect

SF = "/root/testdata/sf0.001"
ROWS_ONLY = {"storage_bytes"}


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_query_has_sql():
    assert set(QUERIES) - set(OWN_SQL) == ROWS_ONLY
    assert set(OWN_SQL) <= set(QUERIES) <= set(queries()) and set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", sorted(OWN_SQL))
def test_equal_to_sql(spark, con, name):
    assert compare(spark, con, SF, queries()[name], oracle_sql()[name]) == ""


def test_storage_bytes(spark):
    assert queries()["storage_bytes"](spark, SF).first()["size_bytes"] > 0


def test_entry(spark):
    assert entry(spark).count() == 10
