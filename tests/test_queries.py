"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
import check
from leafmill.workload import registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in check.TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


entry.queries()  # registers them


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    mine = check.normal(entry.queries()[name](spark, SF).toPandas())
    theirs = check.normal(duck.sql(entry.oracle_sql()[name]).df())
    assert list(mine.columns) == list(theirs.columns)
    assert mine.equals(theirs)


def test_names_match():
    assert set(registry.QUERIES) == set(registry.ORACLES)


def test_entry_is_lazy_enough(spark):
    result = entry.entry(spark)
    assert result.columns == ["category", "split", "n_records", "n_bytes"] and result.count() > 0
