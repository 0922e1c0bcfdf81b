"""Every registered query against its DuckDB oracle (exact value hash), at sf0.001
to keep the suite fast; the driver repeats this at sf0.01."""

import hashlib
import re

import duckdb
import pytest

import __spark_entry__ as E
from tests.conftest import SF_SMALL
from tools.oracle_check import TABLES, digest

SQL = E.oracle_sql()
# the corpus queries have their own tests beside them
NAMES = [n for n in E.queries() if not re.match(r"op\d+_|pipeline$", n)]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


def test_every_query_has_sql():
    assert set(NAMES) <= set(SQL) <= set(E.queries())


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["c_custkey", "c_name", "c_mktsegment", "revenue"]
    assert 0 < df.count() <= 5


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    got = E.queries()[name](spark, SF_SMALL).toPandas()
    want = con.execute(SQL[name]).df()
    c1, r1 = digest(got)
    c2, r2 = digest(want)
    assert c1 == c2
    assert len(r1) == len(r2)
    assert hashlib.sha256(repr(r1).encode()).hexdigest() == hashlib.sha256(repr(r2).encode()).hexdigest()
