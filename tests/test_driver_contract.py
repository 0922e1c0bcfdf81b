"""The driver's view: a fresh process, a stock SparkSession, the three entry points."""

import os
import subprocess
import sys
import textwrap

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_and_queries_in_fresh_stock_session():
    code = textwrap.dedent(f"""
        import sys
        sys.path.insert(0, {REPO!r})
        from pyspark.sql import SparkSession
        spark = (SparkSession.builder.master("local[4]")
                 .config("spark.ui.enabled", "false").getOrCreate())
        import __spark_entry__ as E
        df = E.entry(spark)
        rows = df.collect()
        assert df.columns == ["c_custkey", "c_name", "c_mktsegment", "revenue"], df.columns
        assert 0 < len(rows) <= 5
        q, s = E.queries(), E.oracle_sql()
        assert set(s) <= set(q) and len(q) >= 100
        assert q["group_median"](spark, "/root/testdata/sf0.001").count() == 5
        print("OK", len(q), len(s))
    """)
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=600)
    assert "OK" in out.stdout, out.stderr[-2000:]
