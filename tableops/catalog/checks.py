"""Validation (V1-V7) and conditional-rule (R1-R5) families."""

from __future__ import annotations

from pyspark.sql import functions as F

from tableops.catalog.common import Registry, table
from tableops.operators import quality as V
from tableops.operators import rules as RU
from tableops.operators.lookup import join_tables

R = Registry()
QUERIES, SQL = R.queries, R.sql

_VCOLS = "rule, \"column\", row_key, value"


@R.add("check_allowed", """
SELECT 'dropdown' AS rule, 'c_mktsegment' AS "column", CAST(c_custkey AS VARCHAR) AS row_key,
       c_mktsegment AS value
FROM customer WHERE c_mktsegment IS NOT NULL AND trim(c_mktsegment) <> ''
  AND c_mktsegment NOT IN ('AUTOMOBILE', 'BUILDING', 'FURNITURE')""")
def check_allowed(spark, sf):
    return V.check_allowed(table(spark, sf, "customer"), "c_mktsegment",
                           "AUTOMOBILE, BUILDING; FURNITURE", key="c_custkey")


@R.add("check_range", """
SELECT 'range_check' AS rule, 'c_acctbal' AS "column", CAST(c_custkey AS VARCHAR) AS row_key,
       CAST(c_acctbal AS VARCHAR) AS value
FROM customer WHERE c_acctbal IS NOT NULL AND (c_acctbal < 0 OR c_acctbal > 9000)""")
def check_range(spark, sf):
    return V.check_range(table(spark, sf, "customer"), "c_acctbal", 0, 9000, key="c_custkey")


@R.add("check_length", """
SELECT 'text_length' AS rule, 'p_name' AS "column", CAST(p_partkey AS VARCHAR) AS row_key,
       p_name AS value
FROM part WHERE p_name IS NOT NULL AND trim(p_name) <> '' AND length(p_name) > 9""")
def check_length(spark, sf):
    return V.check_length(table(spark, sf, "part"), "p_name", 9, key="p_partkey")


@R.add("check_unique", """
WITH d AS (SELECT l_orderkey AS a, l_linenumber AS b FROM lineitem
           WHERE l_orderkey IS NOT NULL AND l_linenumber IS NOT NULL
           GROUP BY 1, 2 HAVING count(*) > 1)
SELECT 'no_duplicates' AS rule, 'l_orderkey,l_linenumber' AS "column",
       concat_ws('|', CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR),
                 CAST(l_partkey AS VARCHAR), CAST(l_suppkey AS VARCHAR)) AS row_key,
       concat_ws('|', CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR)) AS value
FROM lineitem JOIN d ON l_orderkey = d.a AND l_linenumber = d.b""")
def check_unique(spark, sf):
    return V.check_unique(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"],
                          key=["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"])


@R.add("check_blank", """
SELECT 'blank_check' AS rule, 'quality' AS "column", CAST(d.doc_id AS VARCHAR) AS row_key,
       CAST(l.quality AS VARCHAR) AS value
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.quality IS NULL""")
def check_blank(spark, sf):
    d = table(spark, sf, "documents").select("doc_id")
    j = join_tables(d, table(spark, sf, "labels"), "doc_id", "left")
    return V.check_blank(j, ["quality"], key="doc_id")


@R.add("check_type", """
SELECT 'data_type' AS rule, 'source' AS "column", CAST(doc_id AS VARCHAR) AS row_key,
       source AS value
FROM documents WHERE source IS NOT NULL AND trim(source) <> ''
  AND TRY_CAST(source AS INTEGER) IS NULL""")
def check_type(spark, sf):
    return V.check_type(table(spark, sf, "documents"), "source", "int", key="doc_id")


QUALITY_SQL = """
SELECT 'dropdown' AS rule, 'c_mktsegment' AS "column", count(*) AS checked,
  count(*) FILTER (WHERE c_mktsegment IS NOT NULL AND trim(c_mktsegment) <> ''
                   AND c_mktsegment NOT IN ('AUTOMOBILE', 'BUILDING', 'FURNITURE')) AS failed
FROM customer
UNION ALL
SELECT 'range_check', 'c_acctbal', count(*),
  count(*) FILTER (WHERE c_acctbal IS NOT NULL AND (c_acctbal < 0 OR c_acctbal > 9000)) FROM customer
UNION ALL
SELECT 'text_length', 'c_name', count(*),
  count(*) FILTER (WHERE c_name IS NOT NULL AND trim(c_name) <> '' AND length(c_name) > 17) FROM customer
UNION ALL
SELECT 'blank_check', 'c_mktsegment', count(*),
  count(*) FILTER (WHERE c_mktsegment IS NULL OR trim(c_mktsegment) = '') FROM customer
UNION ALL
SELECT 'data_type', 'c_name', count(*),
  count(*) FILTER (WHERE c_name IS NOT NULL AND trim(c_name) <> ''
                   AND TRY_CAST(c_name AS INTEGER) IS NULL) FROM customer
UNION ALL
SELECT 'no_duplicates', 'c_nationkey,c_mktsegment', (SELECT count(*) FROM customer),
  (SELECT count(*) FROM customer c JOIN (
     SELECT c_nationkey AS a, c_mktsegment AS b FROM customer
     WHERE c_nationkey IS NOT NULL AND c_mktsegment IS NOT NULL AND trim(c_mktsegment) <> ''
     GROUP BY 1, 2 HAVING count(*) > 1) d ON c.c_nationkey = d.a AND c.c_mktsegment = d.b)"""


@R.add("quality_report", QUALITY_SQL)
def quality_report(spark, sf):
    rules = [V.allowed("c_mktsegment", ["AUTOMOBILE", "BUILDING", "FURNITURE"]),
             V.in_range("c_acctbal", 0, 9000), V.max_length("c_name", 17),
             V.blank("c_mktsegment"), V.of_type("c_name", "int"),
             V.unique(["c_nationkey", "c_mktsegment"])]
    return V.quality_report(table(spark, sf, "customer"), rules)


# --- R1-R5 -----------------------------------------------------------------------------

@R.add("flag_negative", """
SELECT c_custkey, c_acctbal, coalesce(c_acctbal < 0, false) AS is_negative FROM customer""")
def flag_negative(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_acctbal")
    return RU.flag(c, "c_acctbal", "<", 0, "is_negative")


@R.add("flag_positive", """
SELECT o_orderkey, o_totalprice, coalesce(o_totalprice > 250000, false) AS is_big FROM orders""")
def flag_positive(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return RU.flag(o, "o_totalprice", ">", 250000, "is_big")


@R.add("color_when", """
SELECT o_orderkey, o_totalprice,
       CASE WHEN coalesce(o_totalprice > 300000, false) THEN 'FF0000' END AS color FROM orders""")
def color_when(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return RU.color_when(o, "o_totalprice", ">", 300000, "color", "ff0000")


@R.add("data_bar", """
WITH m AS (SELECT min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer)
SELECT c_custkey, c_acctbal,
       round(CASE WHEN hi > lo THEN (c_acctbal - lo) / (hi - lo)
                  WHEN c_acctbal IS NOT NULL THEN 0.0 END, 9) AS bar
FROM customer, m""")
def data_bar(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_acctbal")
    return RU.data_bar(c, "c_acctbal", "bar").withColumn("bar", F.round("bar", 9))


def _scale_channel(a: int, b: int, z: int) -> str:
    return (f"lpad(upper(hex(CAST(round(CASE WHEN x <= md THEN {a} + ({b - a}) * t_lo "
            f"ELSE {b} + ({z - b}) * t_hi END, 0) AS INTEGER))), 2, '0')")


COLOR_SCALE_SQL = f"""
WITH m AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi,
                  quantile_cont(o_totalprice, 0.5) AS md FROM orders),
v AS (SELECT o_orderkey, o_totalprice AS x, md,
        CASE WHEN md > lo THEN (o_totalprice - lo) / (md - lo) ELSE 0.0 END AS t_lo,
        CASE WHEN hi > md THEN (o_totalprice - md) / (hi - md) ELSE 0.0 END AS t_hi
      FROM orders, m)
SELECT o_orderkey, x AS o_totalprice,
  CASE WHEN x IS NOT NULL THEN {_scale_channel(0xF8, 0xFF, 0x63)} || {_scale_channel(0x69, 0xEB, 0xBE)}
       || {_scale_channel(0x6B, 0x84, 0x7B)} END AS color
FROM v"""


@R.add("color_scale", COLOR_SCALE_SQL)
def color_scale(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return RU.color_scale(o, "o_totalprice", "color")


@R.add("check_min_only", """
SELECT 'range_check' AS rule, 'o_totalprice' AS "column", CAST(o_orderkey AS VARCHAR) AS row_key,
       CAST(o_totalprice AS VARCHAR) AS value
FROM orders WHERE o_totalprice IS NOT NULL AND o_totalprice < 10000""")
def check_min_only(spark, sf):
    return V.check_range(table(spark, sf, "orders"), "o_totalprice", lo=10000, key="o_orderkey")
