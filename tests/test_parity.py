"""Every registered query against its SQL on DuckDB."""

import parity
import pytest

import __spark_entry__ as entry_points
from coursemill.plans import catalog, oracle

QUERIES = catalog.REGISTRY
SQL = oracle.build()


@pytest.fixture(scope="module")
def con(sf_dir):
    return parity.connect(sf_dir)


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)
    assert set(QUERIES) <= set(entry_points.queries())
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, con, sf_dir, name):
    difference = parity.compare(spark, con, name, QUERIES[name], SQL[name], sf_dir)
    assert difference is None, difference


def test_entry(spark):
    df = entry_points.entry(spark)
    assert df.columns == ["page_id", "content"]
    assert df.count() > 0
