"""Row-local families: calculations (C), filters (F), transforms (T), order (O)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tableops.catalog.common import Registry, table
from tableops.functions.predicates import token_match
from tableops.operators import calc as C
from tableops.operators import filters as FL
from tableops.operators import order as O
from tableops.operators import transform as T
from tableops.operators.aggregate import group_by
from tableops.operators.lookup import join_tables

R = Registry()
QUERIES, SQL = R.queries, R.sql

# --- flagship: top 5 customers by net revenue (S1, F1, C7, A1, O3) -------------------

FLAGSHIP_SQL = """
SELECT c_custkey, c_name, c_mktsegment,
       round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
              JOIN customer ON o_custkey = c_custkey
WHERE l_quantity >= 5
GROUP BY c_custkey, c_name, c_mktsegment
ORDER BY revenue DESC, c_custkey LIMIT 5
"""


@R.add("top_customers_revenue", FLAGSHIP_SQL)
def top_customers_revenue(spark, sf):
    li = FL.filter_rows(table(spark, sf, "lineitem"), "l_quantity", ">=", 5)
    li = li.withColumn("_keep", 1 - F.col("l_discount"))
    li = C.calc(li, "multiply", ["l_extendedprice", "_keep"], "net")
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    c = table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment")
    j = li.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    g = group_by(j, "o_custkey", [("net", "sum", "revenue")])  # one row a customer meets the names
    g = g.join(c, F.col("o_custkey") == F.col("c_custkey")).select(
        "c_custkey", "c_name", "c_mktsegment", F.round("revenue", 2).alias("revenue"))
    return O.top_k(g, "revenue", 5, tie_break=["c_custkey"])


# --- C1-C12 row-wise calculations on lineitem -------------------------------------------

_CC = ["l_quantity", "l_extendedprice", "l_tax"]
_KEYS = "l_orderkey, l_linenumber, l_partkey, l_suppkey"
_LIST = "[l_quantity, l_extendedprice, l_tax]"
_NN = f"list_filter({_LIST}, lambda x: x IS NOT NULL)"
_CNT = ("(CAST(l_quantity IS NOT NULL AS BIGINT) + CAST(l_extendedprice IS NOT NULL AS BIGINT)"
        " + CAST(l_tax IS NOT NULL AS BIGINT))")
_SUM = "(coalesce(l_quantity, 0.0) + coalesce(l_extendedprice, 0.0) + coalesce(l_tax, 0.0))"

_CALC_SQL = {
    "sum": _SUM,
    "mean": f"{_SUM} / nullif({_CNT}, 0)",
    "min": "least(l_quantity, l_extendedprice, l_tax)",
    "max": "greatest(l_quantity, l_extendedprice, l_tax)",
    "count": _CNT,
    "median": (f"CASE WHEN len({_NN}) = 0 THEN NULL WHEN len({_NN}) % 2 = 1 "
               f"THEN list_sort({_NN})[len({_NN}) // 2 + 1] "
               f"ELSE (list_sort({_NN})[len({_NN}) // 2] + list_sort({_NN})[len({_NN}) // 2 + 1]) / 2 END"),
    "multiply": "l_quantity * l_extendedprice * l_tax",
}
_SPREAD = ["l_quantity", "l_tax", "l_discount"]
_SPREAD_NN = "list_filter([l_quantity, l_tax, l_discount], lambda x: x IS NOT NULL)"
_SPREAD_SQL = {
    "variance": f"round(list_var_samp({_SPREAD_NN}), 6)",
    "std_dev": f"round(list_stddev_samp({_SPREAD_NN}), 6)",
}


def _calc_query(fn):
    def q(spark, sf):
        li = table(spark, sf, "lineitem")
        out = C.calc(li, fn, _CC, "result")
        return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *_CC, "result")
    return q


def _spread_query(fn):
    def q(spark, sf):
        li = table(spark, sf, "lineitem")
        out = C.calc(li, fn, _SPREAD, "result").withColumn("result", F.round("result", 6))
        return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity",
                          "l_tax", "result")
    return q


for _fn, _expr in _CALC_SQL.items():
    R.add(f"calc_{_fn}", f"SELECT {_KEYS}, l_quantity, l_extendedprice, l_tax, {_expr} AS result "
          f"FROM lineitem")(_calc_query(_fn))
for _fn, _expr in _SPREAD_SQL.items():
    R.add(f"calc_{_fn}", f"SELECT {_KEYS}, l_quantity, l_tax, {_expr} AS result "
          f"FROM lineitem")(_spread_query(_fn))


@R.add("calc_divide", f"""
SELECT {_KEYS}, l_extendedprice, CASE WHEN l_discount = 0 THEN NULL
       ELSE l_extendedprice / l_discount END AS result FROM lineitem""")
def calc_divide(spark, sf):
    out = C.calc(table(spark, sf, "lineitem"), "divide", ["l_extendedprice", "l_discount"], "result")
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "result")


@R.add("calc_percentage", f"""
SELECT {_KEYS}, l_tax, round(CASE WHEN l_quantity = 0 THEN NULL
       ELSE l_tax / l_quantity END * 100, 9) AS result FROM lineitem""")
def calc_percentage(spark, sf):
    out = C.calc(table(spark, sf, "lineitem"), "percentage", ["l_tax", "l_quantity"], "result")
    return out.withColumn("result", F.round("result", 9)).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_tax", "result")


@R.add("pct_of_total", """
SELECT o_orderkey, o_totalprice,
       round(o_totalprice / (SELECT sum(o_totalprice) FROM orders) * 100, 9) AS pct
FROM orders""")
def pct_of_total(spark, sf):
    out = C.calc(table(spark, sf, "orders"), "percentage", ["o_totalprice"], "pct")
    return out.select("o_orderkey", "o_totalprice", F.round("pct", 9).alias("pct"))


# --- F1-F8 filters ----------------------------------------------------------------------

# + 0.0 on both sides: -0.0 and 0.0 are equal but hash apart
_LI = ("l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_tax, l_discount + 0.0 AS l_discount, "
       "l_returnflag, l_linestatus, l_shipdate")


@R.add("filter_ge", f"SELECT {_LI} FROM lineitem WHERE l_quantity >= 30")
def filter_ge(spark, sf):
    return FL.filter_rows(table(spark, sf, "lineitem"), "l_quantity", ">=", 30).selectExpr(*_LI.split(", "))


@R.add("filter_lt", "SELECT * FROM orders WHERE o_totalprice < 50000")
def filter_lt(spark, sf):
    return FL.filter_rows(table(spark, sf, "orders"), "o_totalprice", "<", 50000)


@R.add("filter_eq_text", "SELECT * FROM orders WHERE o_orderstatus = 'F'")
def filter_eq_text(spark, sf):
    return FL.filter_rows(table(spark, sf, "orders"), "o_orderstatus", "==", "F")


@R.add("filter_eq_number", "SELECT * FROM part WHERE p_size = 10")
def filter_eq_number(spark, sf):
    return FL.filter_rows(table(spark, sf, "part"), "p_size", "==", "10")


@R.add("filter_ne", "SELECT * FROM orders WHERE o_orderpriority IS DISTINCT FROM '1-URGENT'")
def filter_ne(spark, sf):
    return FL.filter_rows(table(spark, sf, "orders"), "o_orderpriority", "!=", "1-URGENT")


@R.add("filter_contains", "SELECT * FROM part WHERE regexp_matches(p_name, 'R[io]NG', 'i')")
def filter_contains(spark, sf):
    return FL.filter_rows(table(spark, sf, "part"), "p_name", "contains", "R[io]NG")


@R.add("filter_startswith", "SELECT * FROM customer WHERE starts_with(c_mktsegment, 'AUTO')")
def filter_startswith(spark, sf):
    return FL.filter_rows(table(spark, sf, "customer"), "c_mktsegment", "startswith", "AUTO")


@R.add("filter_endswith", "SELECT * FROM part WHERE ends_with(p_type, 'UM')")
def filter_endswith(spark, sf):
    return FL.filter_rows(table(spark, sf, "part"), "p_type", "endswith", "UM")


@R.add("filter_any_token", "SELECT * FROM part WHERE regexp_matches(p_name, '(red|BOLT)', 'i')")
def filter_any_token(spark, sf):
    return FL.filter_any_token(table(spark, sf, "part"), "p_name", ["red", "BOLT"])


@R.add("search_rows", """
SELECT * FROM customer WHERE
  contains(lower(CAST(c_custkey AS VARCHAR)), '#0000001')
  OR contains(lower(c_name), '#0000001')
  OR contains(lower(CAST(c_nationkey AS VARCHAR)), '#0000001')
  OR contains(lower(CAST(c_acctbal AS VARCHAR)), '#0000001')
  OR contains(lower(c_mktsegment), '#0000001')""")
def search_rows(spark, sf):
    return FL.search_rows(table(spark, sf, "customer"), "#0000001")


_TM_S = "lower(trim(regexp_replace(p_type, '\\s+', ' ', 'g')))"
_TM_V = "lower(trim(regexp_replace(p_name, '\\s+', ' ', 'g')))"
TOKEN_MATCH_SQL = f"""
SELECT p_partkey, p_type, p_name,
  ({_TM_S} <> '' AND {_TM_V} <> '' AND (
     contains({_TM_V}, {_TM_S}) OR contains({_TM_S}, {_TM_V})
     OR len(list_filter(string_split(translate({_TM_V}, '()', '  '), ' '),
            lambda w: w <> '' AND (contains(w, {_TM_S}) OR contains({_TM_S}, w)
                 OR (length({_TM_S}) >= 3 AND starts_with(w, substr({_TM_S}, 1, 3)))
                 OR (length(w) >= 3 AND starts_with({_TM_S}, substr(w, 1, 3)))))) > 0
     OR len(list_filter(string_split({_TM_S}, ' '),
            lambda t: len(list_filter(string_split({_TM_V}, ' '), lambda u: contains(u, t))) > 0)) > 0
  )) AS matched
FROM part"""


@R.add("token_match", TOKEN_MATCH_SQL)
def token_match_q(spark, sf):
    p = table(spark, sf, "part")
    return p.select("p_partkey", "p_type", "p_name",
                    token_match(F.col("p_type"), F.col("p_name")).alias("matched"))


# --- T1-T13 transforms ------------------------------------------------------------------

@R.add("select_as", "SELECT c_custkey AS id, c_name AS name FROM customer")
def select_as(spark, sf):
    return T.select_as(table(spark, sf, "customer"), {"c_custkey": "id", "c_name": "name"})


@R.add("add_column", "SELECT *, CAST(NULL AS VARCHAR) AS notes FROM region")
def add_column(spark, sf):
    return T.add_column(table(spark, sf, "region"), "notes")


@R.add("rename_column", "SELECT n_nationkey, n_name AS nation, n_regionkey FROM nation")
def rename_column(spark, sf):
    return T.rename_column(table(spark, sf, "nation"), "n_name", "nation")


@R.add("remove_column", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders")
def remove_column(spark, sf):
    return T.remove_column(table(spark, sf, "orders"), ["o_orderdate", "o_orderpriority", "no_such"])


@R.add("split_column", """
SELECT p_partkey, p_name,
  string_split(nullif(trim(regexp_replace(p_name, '\\s+', ' ', 'g')), ''), ' ')[1] AS adjective,
  string_split(nullif(trim(regexp_replace(p_name, '\\s+', ' ', 'g')), ''), ' ')[2] AS noun,
  string_split(nullif(trim(regexp_replace(p_name, '\\s+', ' ', 'g')), ''), ' ')[3] AS extra
FROM part""")
def split_column(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_name")
    return T.split_column(p, "p_name", ["adjective", "noun", "extra"])


@R.add("merge_columns", """
SELECT c_custkey, concat_ws(' ', coalesce(c_name, ''), coalesce(c_mktsegment, '')) AS label
FROM customer""")
def merge_columns(spark, sf):
    c = table(spark, sf, "customer")
    return T.merge_columns(c, ["c_name", "c_mktsegment"], "label").select("c_custkey", "label")


@R.add("replace_values", """
SELECT p_partkey, CASE WHEN p_type = 'SMALL' THEN 'TINY' ELSE p_type END AS p_type FROM part""")
def replace_values(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_type")
    return T.replace_values(p, "SMALL", "TINY", ["p_type"])


@R.add("fill_missing", """
SELECT d.doc_id, coalesce(l.quality, 0) AS quality, coalesce(l.toxic, 0) AS toxic
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def fill_missing(spark, sf):
    d = table(spark, sf, "documents").select("doc_id")
    lab = table(spark, sf, "labels")
    j = join_tables(d, lab, "doc_id", "left")
    return T.fill_missing(j, 0, ["quality", "toxic"])


@R.add("to_numeric", """
SELECT p_partkey, TRY_CAST(replace(trim(split_part(p_brand, '#', 2)), ',', '') AS DOUBLE) AS brand_no
FROM part""")
def to_numeric(spark, sf):
    p = table(spark, sf, "part").select(
        "p_partkey", F.substring_index("p_brand", "#", -1).alias("brand_no"))
    return T.to_numeric(p, ["brand_no"])


@R.add("bin_values", """
SELECT event_id, value, CASE
  WHEN value > 0 AND value <= 100 THEN '0-100'
  WHEN value > 100 AND value <= 200 THEN '100-200'
  WHEN value > 200 AND value <= 300 THEN '200-300'
  WHEN value > 300 AND value <= 400 THEN '300-400'
  WHEN value > 400 AND value <= 500 THEN '400-500' END AS bucket
FROM events""")
def bin_values(spark, sf):
    e = table(spark, sf, "events").select("event_id", "value")
    return T.bin_values(e, "value", [0, 100, 200, 300, 400, 500],
                        ["0-100", "100-200", "200-300", "300-400", "400-500"], "bucket")


@R.add("normalize_text", """
SELECT doc_id, coalesce(trim(regexp_replace(text, '\\s+', ' ', 'g')), '') AS text FROM documents""")
def normalize_text(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text")
    return T.normalize_text(d, "text")


@R.add("drop_missing", """
SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
WHERE l.quality IS NOT NULL""")
def drop_missing(spark, sf):
    d = table(spark, sf, "documents").select("doc_id")
    j = join_tables(d, table(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left")
    return T.drop_missing(j, ["quality"])


@R.add("number_format", """
SELECT o_orderkey, format('{:,.2f}', o_totalprice) AS amount,
       '$' || format('{:,.2f}', o_totalprice) AS price FROM orders""")
def number_format(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    o = T.number_format(o, "o_totalprice", "number", 2, out="amount")
    return T.number_format(o, "o_totalprice", "currency", 2, out="price").drop("o_totalprice")


# --- O1-O4 ordering ---------------------------------------------------------------------

@R.add("sort_asc", "SELECT * FROM orders ORDER BY o_totalprice ASC NULLS LAST")
def sort_asc(spark, sf):
    return O.sort_rows(table(spark, sf, "orders"), ["o_totalprice"])


@R.add("sort_desc", "SELECT * FROM customer ORDER BY c_acctbal DESC NULLS LAST")
def sort_desc(spark, sf):
    return O.sort_rows(table(spark, sf, "customer"), ["c_acctbal"], desc=True)


@R.add("top_k", """
SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey, o_custkey LIMIT 10""")
def top_k(spark, sf):
    return O.top_k(table(spark, sf, "orders"), "o_totalprice", 10, tie_break=["o_orderkey"])


@R.add("dedup_first", f"""
SELECT {_LI} FROM (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey,
    l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus,
    l_shipdate) AS rn FROM lineitem) WHERE rn = 1""")
def dedup_first(spark, sf):
    li = table(spark, sf, "lineitem")
    return O.deduplicate(li, ["l_orderkey"], order_by=["l_linenumber"]).selectExpr(*_LI.split(", "))


# --- variants ---------------------------------------------------------------------------

@R.add("filter_le", "SELECT * FROM part WHERE p_retailprice <= 1000")
def filter_le(spark, sf):
    return FL.filter_rows(table(spark, sf, "part"), "p_retailprice", "<=", 1000)


@R.add("filter_gt", "SELECT * FROM customer WHERE c_acctbal > 9000")
def filter_gt(spark, sf):
    return FL.filter_rows(table(spark, sf, "customer"), "c_acctbal", ">", 9000)


@R.add("dedup_keys", """
SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem""")
def dedup_keys(spark, sf):
    li = table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus")
    return O.deduplicate(li, ["l_returnflag", "l_linestatus"])


@R.add("fill_missing_text", """
SELECT coalesce(l.doc_id, p.page_id) AS doc_id, CAST(l.quality AS DOUBLE) AS quality,
       CAST(l.toxic AS DOUBLE) AS toxic, coalesce(p.url, 'N/A') AS url
FROM labels l FULL OUTER JOIN pages p ON l.doc_id IS NOT DISTINCT FROM p.page_id""")
def fill_missing_text(spark, sf):
    pages = table(spark, sf, "pages").select(F.col("page_id").alias("doc_id"), "url")
    out = T.fill_missing(join_tables(table(spark, sf, "labels"), pages, "doc_id", "outer"))  # 'N/A' into text
    # integers left NULL by the outer join are reported as DOUBLE (see catalog.joins)
    return out.withColumns({c: F.col(c).cast("double") for c in ["quality", "toxic"]})


# --- whole web pages -------------------------------------------------------------------

@R.add("normalize_pages", """
SELECT page_id, coalesce(trim(regexp_replace(html, '\\s+', ' ', 'g')), '') AS html FROM pages""")
def normalize_pages(spark, sf):
    """T10 over whole raw HTML pages."""
    return T.normalize_text(table(spark, sf, "pages").select("page_id", "html"), "html")


@R.add("search_pages", """
SELECT * FROM pages WHERE
  contains(lower(CAST(page_id AS VARCHAR)), 'lang="de"')
  OR contains(lower(url), 'lang="de"') OR contains(lower(html), 'lang="de"')""")
def search_pages(spark, sf):
    """F7 over whole pages: rows whose text anywhere contains the term."""
    return FL.search_rows(table(spark, sf, "pages"), 'LANG="de"')
