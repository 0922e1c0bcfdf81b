"""Aggregation family (A1-A10)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tableops.catalog.common import Registry, table
from tableops.operators import aggregate as A

R = Registry()
QUERIES, SQL = R.queries, R.sql


@R.add("group_sum", """
SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty,
       round(sum(l_extendedprice), 2) AS sum_price
FROM lineitem GROUP BY l_returnflag, l_linestatus""")
def group_sum(spark, sf):
    g = A.group_by(table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"],
                   [("l_quantity", "sum", "sum_qty"), ("l_extendedprice", "sum", "sum_price")])
    return g.withColumn("sum_price", F.round("sum_price", 2))


@R.add("group_mean", """
SELECT l_returnflag, round(avg(l_extendedprice), 6) AS avg_price, round(avg(l_quantity), 6) AS avg_qty
FROM lineitem GROUP BY l_returnflag""")
def group_mean(spark, sf):
    g = A.group_by(table(spark, sf, "lineitem"), "l_returnflag",
                   [("l_extendedprice", "mean", "avg_price"), ("l_quantity", "mean", "avg_qty")])
    return g.select("l_returnflag", F.round("avg_price", 6).alias("avg_price"),
                    F.round("avg_qty", 6).alias("avg_qty"))


@R.add("group_count", """
SELECT o_orderstatus, count(*) AS "Count" FROM orders GROUP BY o_orderstatus""")
def group_count(spark, sf):
    return A.group_count(table(spark, sf, "orders"), "o_orderstatus")


@R.add("group_min_max", """
SELECT c_mktsegment, min(c_acctbal) AS min_bal, max(c_acctbal) AS max_bal,
       count(c_acctbal) AS n FROM customer GROUP BY c_mktsegment""")
def group_min_max(spark, sf):
    return A.group_by(table(spark, sf, "customer"), "c_mktsegment",
                      [("c_acctbal", "min", "min_bal"), ("c_acctbal", "max", "max_bal"),
                       ("c_acctbal", "count", "n")])


@R.add("group_median", """
SELECT o_orderpriority, round(median(o_totalprice), 6) AS median_price
FROM orders GROUP BY o_orderpriority""")
def group_median(spark, sf):
    g = A.group_by(table(spark, sf, "orders"), "o_orderpriority",
                   [("o_totalprice", "median", "median_price")])
    return g.withColumn("median_price", F.round("median_price", 6))


@R.add("group_std", """
SELECT o_orderstatus, round(stddev_samp(o_totalprice), 6) AS std_price
FROM orders GROUP BY o_orderstatus""")
def group_std(spark, sf):
    g = A.group_by(table(spark, sf, "orders"), "o_orderstatus",
                   [("o_totalprice", "std", "std_price")])
    return g.withColumn("std_price", F.round("std_price", 6))


@R.add("value_counts", """
SELECT o_orderpriority, count(*) AS "Count" FROM orders
WHERE o_orderpriority IS NOT NULL GROUP BY o_orderpriority""")
def value_counts(spark, sf):
    return A.value_counts(table(spark, sf, "orders"), "o_orderpriority")


@R.add("pivot_sum", """
SELECT l_returnflag,
  coalesce(sum(CASE WHEN l_linestatus = 'F' THEN l_quantity END), 0) AS "F",
  coalesce(sum(CASE WHEN l_linestatus = 'O' THEN l_quantity END), 0) AS "O"
FROM lineitem WHERE l_returnflag IS NOT NULL AND l_linestatus IS NOT NULL
GROUP BY l_returnflag""")
def pivot_sum(spark, sf):
    return A.pivot_table(table(spark, sf, "lineitem"), "l_returnflag", "l_linestatus",
                         "l_quantity", "sum", values=["F", "O"])


@R.add("pivot_count", """
SELECT o_orderpriority,
  count(CASE WHEN o_orderstatus = 'F' THEN 1 END) AS "F",
  count(CASE WHEN o_orderstatus = 'O' THEN 1 END) AS "O",
  count(CASE WHEN o_orderstatus = 'P' THEN 1 END) AS "P"
FROM orders WHERE o_orderpriority IS NOT NULL AND o_orderstatus IS NOT NULL
GROUP BY o_orderpriority""")
def pivot_count(spark, sf):
    return A.pivot_table(table(spark, sf, "orders"), "o_orderpriority", "o_orderstatus")


@R.add("pivot_mean", """
SELECT l_returnflag,
  round(coalesce(avg(CASE WHEN l_linestatus = 'F' THEN l_extendedprice END), 0), 6) AS "F",
  round(coalesce(avg(CASE WHEN l_linestatus = 'O' THEN l_extendedprice END), 0), 6) AS "O"
FROM lineitem WHERE l_returnflag IS NOT NULL AND l_linestatus IS NOT NULL
GROUP BY l_returnflag""")
def pivot_mean(spark, sf):
    p = A.pivot_table(table(spark, sf, "lineitem"), "l_returnflag", "l_linestatus",
                      "l_extendedprice", "mean", values=["F", "O"])
    return p.select("l_returnflag", F.round("F", 6).alias("F"), F.round("O", 6).alias("O"))


_PRI = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
CROSS_TAB_SQL = """
WITH c AS (
  SELECT o_orderstatus AS a, o_orderpriority AS b, count(*) AS n,
         grouping(o_orderstatus) AS ga, grouping(o_orderpriority) AS gb
  FROM orders WHERE o_orderstatus IS NOT NULL AND o_orderpriority IS NOT NULL
  GROUP BY CUBE (o_orderstatus, o_orderpriority))
SELECT CASE WHEN ga = 1 THEN 'Total' ELSE a END AS o_orderstatus,
""" + ",\n".join(
    f"  coalesce(max(CASE WHEN gb = 0 AND b = '{p}' THEN n END), 0) AS \"{p}\"" for p in _PRI
) + """,
  coalesce(max(CASE WHEN gb = 1 THEN n END), 0) AS "Total"
FROM c GROUP BY 1"""


@R.add("cross_tab", CROSS_TAB_SQL)
def cross_tab(spark, sf):
    return A.cross_tab(table(spark, sf, "orders"), "o_orderstatus", "o_orderpriority")


_DESC_COLS = ["l_quantity", "l_extendedprice", "l_tax"]
SUMMARY_SQL = "\nUNION ALL\n".join(f"""
SELECT '{c}' AS "Column", count({c}) AS "Count", round(avg({c}), 6) AS "Mean",
  round(stddev_samp({c}), 6) AS "Std", min({c}) AS "Min",
  round(quantile_cont({c}, 0.25), 6) AS "25%", round(quantile_cont({c}, 0.5), 6) AS "50%",
  round(quantile_cont({c}, 0.75), 6) AS "75%", max({c}) AS "Max" FROM lineitem""" for c in _DESC_COLS)


@R.add("summary_stats", SUMMARY_SQL)
def summary_stats(spark, sf):
    s = A.summary_stats(table(spark, sf, "lineitem"), _DESC_COLS)
    return s.withColumns({c: F.round(F.col(f"`{c}`"), 6) for c in ["Mean", "Std", "25%", "50%", "75%"]})


@R.add("subtotals", """
SELECT o_orderkey, o_custkey, o_orderstatus, round(o_totalprice, 2) AS o_totalprice,
       o_orderdate, o_orderpriority, false AS _is_subtotal
FROM orders WHERE o_orderstatus IS NOT NULL
UNION ALL
SELECT CAST(sum(o_orderkey) AS BIGINT), CAST(sum(o_custkey) AS BIGINT),
       o_orderstatus || ' - SUBTOTAL', round(sum(o_totalprice), 2), NULL, NULL, true
FROM orders WHERE o_orderstatus IS NOT NULL GROUP BY o_orderstatus""")
def subtotals(spark, sf):
    s = A.subtotals(table(spark, sf, "orders"), "o_orderstatus", order_by=["o_orderkey"])
    return s.withColumn("o_totalprice", F.round("o_totalprice", 2))


@R.add("column_stat", """
SELECT round(avg(o_totalprice), 6) AS o_totalprice, round(avg(o_custkey), 6) AS o_custkey FROM orders""")
def column_stat(spark, sf):
    s = A.column_stat(table(spark, sf, "orders"), ["o_totalprice", "o_custkey"], "mean")
    return s.select(F.round("o_totalprice", 6).alias("o_totalprice"),
                    F.round("o_custkey", 6).alias("o_custkey"))


@R.add("rollup_totals", """
SELECT l_returnflag, l_linestatus, sum(l_quantity) AS l_quantity,
       round(sum(l_extendedprice), 2) AS l_extendedprice,
       CAST(grouping(l_returnflag, l_linestatus) AS BIGINT) AS level
FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)""")
def rollup_totals(spark, sf):
    r = A.rollup_totals(table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"],
                        ["l_quantity", "l_extendedprice"])
    return r.withColumn("l_extendedprice", F.round("l_extendedprice", 2))


@R.add("pivot_median", """
SELECT l_linestatus,
  coalesce(round(median(l_extendedprice) FILTER (WHERE l_returnflag = 'A'), 6), 0) AS "A",
  coalesce(round(median(l_extendedprice) FILTER (WHERE l_returnflag = 'N'), 6), 0) AS "N",
  coalesce(round(median(l_extendedprice) FILTER (WHERE l_returnflag = 'R'), 6), 0) AS "R"
FROM lineitem WHERE l_returnflag IS NOT NULL AND l_linestatus IS NOT NULL
GROUP BY l_linestatus
HAVING count(l_extendedprice) > 0""")
def pivot_median(spark, sf):
    p = A.pivot_table(table(spark, sf, "lineitem"), "l_linestatus", "l_returnflag",
                      "l_extendedprice", "median", values=["A", "N", "R"])
    return p.select("l_linestatus", *[F.round(c, 6).alias(c) for c in ["A", "N", "R"]])


@R.add("group_median_two_keys", """
SELECT c_mktsegment, c_nationkey, round(median(c_acctbal), 6) AS median_bal,
       round(avg(c_acctbal), 6) AS mean_bal, count(c_acctbal) AS n
FROM customer WHERE c_mktsegment IS NOT NULL AND c_nationkey IS NOT NULL
GROUP BY c_mktsegment, c_nationkey""")
def group_median_two_keys(spark, sf):
    g = A.group_by(table(spark, sf, "customer"), ["c_mktsegment", "c_nationkey"],
                   [("c_acctbal", "median", "median_bal"), ("c_acctbal", "mean", "mean_bal"),
                    ("c_acctbal", "count", "n")])
    return g.withColumns({"median_bal": F.round("median_bal", 6), "mean_bal": F.round("mean_bal", 6)})


@R.add("column_median", """
SELECT round(median(o_totalprice), 6) AS o_totalprice, round(median(o_custkey), 6) AS o_custkey
FROM orders""")
def column_median(spark, sf):
    s = A.column_stat(table(spark, sf, "orders"), ["o_totalprice", "o_custkey"], "median")
    return s.select(F.round("o_totalprice", 6).alias("o_totalprice"),
                    F.round("o_custkey", 6).alias("o_custkey"))


@R.add("rollup_median", """
SELECT l_returnflag, l_linestatus, round(median(l_extendedprice), 6) AS l_extendedprice,
       CAST(grouping(l_returnflag, l_linestatus) AS BIGINT) AS level
FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)""")
def rollup_median(spark, sf):
    r = A.rollup_totals(table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"],
                        ["l_extendedprice"], "median")
    return r.withColumn("l_extendedprice", F.round("l_extendedprice", 6))
