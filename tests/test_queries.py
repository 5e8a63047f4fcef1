"""Every registered query at the smallest scale, next to its SQL where there is one."""

import pytest

import __spark_entry__ as contract
from check import compare, connect

FOLDER = "/root/testdata/sf0.001"
QUERIES, SQL = contract.queries(), contract.oracle_sql()
# Rows that SQL gives at larger scales only.
MAY_BE_EMPTY = {"link_matched", "link_claim_conflicts", "dictionary_hits", "filter_columns", "search_all_columns"}


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    message, _, failed = compare(spark, con, FOLDER, name, QUERIES[name], SQL.get(name))
    assert not failed or (name in MAY_BE_EMPTY and message == "ok 0"), message


def test_contract(spark):
    assert set(SQL) <= set(QUERIES)
    df = contract.entry(spark)
    assert df.count() > 0 and df.columns == ["tier", "c_mktsegment", "n_orders", "revenue"]
