"""Lookup and join family."""

from __future__ import annotations

from pyspark.sql import functions as F

from tableops.catalog.common import Registry, table
from tableops.operators import aggregate as A
from tableops.operators import lookup as J

R = Registry()
QUERIES, SQL = R.queries, R.sql


@R.add("lookup_nation", """
SELECT c_custkey, c_nationkey, n.n_name AS nation
FROM customer LEFT JOIN nation n ON c_nationkey IS NOT DISTINCT FROM n.n_nationkey""")
def lookup_nation(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    return J.lookup(c, table(spark, sf, "nation"), "c_nationkey", "n_name", "nation",
                    ref_key="n_nationkey")




@R.add("lookup_last", f"""
WITH last AS (
  SELECT l_orderkey, l_shipdate FROM (
    SELECT l_orderkey, l_shipdate,
           row_number() OVER (PARTITION BY l_orderkey
             ORDER BY l_linenumber DESC NULLS LAST, l_shipdate DESC NULLS LAST) AS rn
    FROM lineitem) WHERE rn = 1)
SELECT o_orderkey, o_orderdate, last.l_shipdate AS last_ship
FROM orders LEFT JOIN last ON o_orderkey IS NOT DISTINCT FROM last.l_orderkey""")
def lookup_last(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    return J.lookup(o, table(spark, sf, "lineitem"), "o_orderkey", "l_shipdate", "last_ship",
                    order_by=["l_linenumber"], ref_key="l_orderkey")


@R.add("index_match", f"""
WITH last AS (
  SELECT l_orderkey AS k, l_quantity AS v FROM (
    SELECT l_orderkey, l_quantity,
           row_number() OVER (PARTITION BY l_orderkey
             ORDER BY l_linenumber DESC NULLS LAST, l_quantity DESC NULLS LAST) AS rn
    FROM lineitem) WHERE rn = 1)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, last.v AS last_qty
FROM lineitem LEFT JOIN last ON l_orderkey IS NOT DISTINCT FROM last.k""")
def index_match(spark, sf):
    li = table(spark, sf, "lineitem")
    out = J.index_match(li, "l_orderkey", "l_quantity", "last_qty", order_by=["l_linenumber"])
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "last_qty")


def _docs(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "lang", "n_chars")


# Integer columns that may be NULL after an outer join are reported as DOUBLE on both
# sides: pandas turns a Spark integer column with NULLs into float64, DuckDB keeps a
# nullable integer, and the value check should compare values, not dtypes.
def _nullable_ints_as_double(df, cols):
    return df.withColumns({c: F.col(c).cast("double") for c in cols})


@R.add("join_left", """
SELECT d.doc_id, d.lang, d.n_chars, CAST(l.quality AS DOUBLE) AS quality,
       CAST(l.toxic AS DOUBLE) AS toxic
FROM documents d LEFT JOIN labels l ON d.doc_id IS NOT DISTINCT FROM l.doc_id""")
def join_left(spark, sf):
    j = J.join_tables(_docs(spark, sf), table(spark, sf, "labels"), "doc_id", "left")
    return _nullable_ints_as_double(j, ["quality", "toxic"])


@R.add("join_inner", """
SELECT d.doc_id, d.lang, d.n_chars, l.quality, l.toxic
FROM documents d JOIN labels l ON d.doc_id IS NOT DISTINCT FROM l.doc_id""")
def join_inner(spark, sf):
    return J.join_tables(_docs(spark, sf), table(spark, sf, "labels"), "doc_id", "inner")


@R.add("join_right", """
SELECT coalesce(l.doc_id, d.doc_id) AS doc_id, CAST(l.quality AS DOUBLE) AS quality,
       CAST(l.toxic AS DOUBLE) AS toxic, d.lang, d.n_chars
FROM labels l RIGHT JOIN documents d ON d.doc_id IS NOT DISTINCT FROM l.doc_id""")
def join_right(spark, sf):
    j = J.join_tables(table(spark, sf, "labels"), _docs(spark, sf), "doc_id", "right")
    return _nullable_ints_as_double(j, ["quality", "toxic"])


@R.add("join_outer", """
SELECT coalesce(l.doc_id, p.page_id) AS doc_id, CAST(l.quality AS DOUBLE) AS quality,
       CAST(l.toxic AS DOUBLE) AS toxic, p.url
FROM labels l FULL OUTER JOIN pages p ON l.doc_id IS NOT DISTINCT FROM p.page_id""")
def join_outer(spark, sf):
    pages = table(spark, sf, "pages").select(F.col("page_id").alias("doc_id"), "url")
    j = J.join_tables(table(spark, sf, "labels"), pages, "doc_id", "outer")
    return _nullable_ints_as_double(j, ["quality", "toxic"])


@R.add("join_clash", """
WITH c AS (SELECT c_nationkey AS nationkey, count(*) AS n, round(avg(c_acctbal), 6) AS avg_bal
           FROM customer WHERE c_nationkey IS NOT NULL GROUP BY c_nationkey),
     s AS (SELECT s_nationkey AS nationkey, count(*) AS n, round(avg(s_acctbal), 6) AS avg_bal
           FROM supplier WHERE s_nationkey IS NOT NULL GROUP BY s_nationkey)
SELECT coalesce(c.nationkey, s.nationkey) AS nationkey, c.n AS n_x, c.avg_bal AS avg_bal_x,
       s.n AS n_y, s.avg_bal AS avg_bal_y
FROM c FULL OUTER JOIN s ON c.nationkey IS NOT DISTINCT FROM s.nationkey""")
def join_clash(spark, sf):
    def per_nation(t, key, bal):
        g = A.group_by(table(spark, sf, t).withColumnRenamed(key, "nationkey"), "nationkey",
                       [(bal, "count", "n"), (bal, "mean", "avg_bal")])
        return g.withColumn("avg_bal", F.round("avg_bal", 6))
    c = per_nation("customer", "c_nationkey", "c_acctbal")
    s = per_nation("supplier", "s_nationkey", "s_acctbal")
    return J.join_tables(c, s, "nationkey", "outer")


_FS = "lower(trim(regexp_replace(p_name, '\\s+', ' ', 'g')))"
_FV = "lower(trim(regexp_replace(t, '\\s+', ' ', 'g')))"
_FW = f"list_filter(string_split(translate({_FV}, '()', '  '), ' '), lambda w: w <> '')"
FUZZY_SQL = f"""
WITH types AS (SELECT DISTINCT p_type AS t FROM part WHERE p_type IS NOT NULL),
cand AS (
  SELECT p_partkey, t, length({_FV}) AS len, {_FV} AS n,
    CASE WHEN {_FV} = {_FS} THEN 1 WHEN contains({_FV}, {_FS}) THEN 2 WHEN contains({_FS}, {_FV}) THEN 3
         WHEN len(list_filter(string_split({_FS}, ' '), lambda a: contains({_FV}, a))) > 0 THEN 4
         WHEN len(list_filter({_FW}, lambda w: contains({_FS}, w))) > 0 THEN 5
         WHEN length({_FS}) >= 3 AND len(list_filter({_FW}, lambda w: length(w) >= 3
              AND substr(w, 1, 3) = substr({_FS}, 1, 3))) > 0 THEN 6 END AS tier
  FROM part, types WHERE {_FS} <> '' AND {_FV} <> '')
SELECT p.p_partkey, p.p_name, m.t AS matched_type
FROM part p LEFT JOIN (SELECT p_partkey, arg_min(t, (tier, len, n, t)) AS t FROM cand WHERE tier IS NOT NULL GROUP BY p_partkey) m
  ON p.p_partkey = m.p_partkey"""


@R.add("fuzzy_match", FUZZY_SQL)
def fuzzy_match(spark, sf):
    p = table(spark, sf, "part")
    types = p.select("p_type")
    return J.fuzzy_match(p.select("p_partkey", "p_name"), types, "p_name", "p_type", "matched_type")


NEAREST_SQL = """
WITH t AS (SELECT c_custkey, substr(c_name, 1, (c_custkey % length(c_name))::INTEGER)
             || CASE WHEN c_custkey % 3 = 0 THEN 'x' ELSE '' END
             || substr(c_name, (c_custkey % length(c_name))::INTEGER + 2 - (c_custkey % 2)::INTEGER)
             || CASE WHEN c_custkey % 7 = 0 THEN ' q' ELSE '' END AS typed FROM customer),
v AS (SELECT lower(c_name) AS n, min(c_name) AS v FROM customer GROUP BY lower(c_name)),
d AS (SELECT DISTINCT lower(typed) AS typed FROM t),
best AS (SELECT typed, v, dist, row_number() OVER (PARTITION BY typed ORDER BY dist, length(n), n) AS k
         FROM (SELECT typed, n, v, levenshtein(typed, n) AS dist FROM d, v
               WHERE abs(length(typed) - length(n)) <= 1) WHERE dist <= 1)
SELECT c_custkey, t.typed, v AS meant, dist::INTEGER AS edits FROM t LEFT JOIN best ON lower(t.typed) = best.typed AND best.k = 1"""


@R.add("fuzzy_nearest", NEAREST_SQL)
def fuzzy_nearest(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_name")
    at = (F.col("c_custkey") % F.length("c_name")).cast("int")
    typed = F.concat(F.substring("c_name", F.lit(1), at), F.when(F.col("c_custkey") % 3 == 0, "x").otherwise(""),
                     F.substring("c_name", at + 2 - (F.col("c_custkey") % 2).cast("int"), F.length("c_name")),
                     F.when(F.col("c_custkey") % 7 == 0, " q").otherwise(""))
    return J.nearest_match(c.withColumn("typed", typed).select("c_custkey", "typed"), c, "typed", "c_name", "meant", max_edits=1, distance="edits")
