"""Corpus queries that SQL expresses, against DuckDB on the smallest tables."""

import duckdb
import pytest

from tableops.llm.catalog import R
from tests.conftest import SF_SMALL
from tools.oracle_check import digest


@pytest.mark.parametrize("name", sorted(R.sql))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    assert digest(R.queries[name](spark, SF_SMALL).toPandas()) == digest(con.execute(R.sql[name]).df())
