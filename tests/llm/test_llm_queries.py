"""Registered corpus queries against their SQL, on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
import check
from leafmill.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query(spark, name):
    con = duckdb.connect()
    for table in ("documents", "pages", "embeddings", "benchmark"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    mine = check.normal(queries.QUERIES[name](spark, SF).toPandas())
    theirs = check.normal(con.sql(queries.ORACLES[name]).df())
    assert list(mine.columns) == list(theirs.columns)
    assert mine.equals(theirs)


def test_every_operator_is_registered():
    found = entry.queries()
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
    assert "pipeline" in found and set(queries.ORACLES) <= set(entry.oracle_sql())
