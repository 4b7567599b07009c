"""Every registered query runs on the smallest tables; those with SQL give the same rows as DuckDB."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from sparkloom.plans import catalogue
from tests import compare

QUERIES, SQL = catalogue.REGISTRY.queries, catalogue.REGISTRY.sql


@pytest.fixture(scope="module")
def con(sf_dir):
    return compare.connection(sf_dir)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, con, name):
    df = QUERIES[name](spark, sf_dir)
    got = compare.rows(df.columns, df.collect())
    if name in SQL:
        assert got == compare.of_sql(con, SQL[name])
    else:
        assert got[1]


def test_the_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(QUERIES) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
