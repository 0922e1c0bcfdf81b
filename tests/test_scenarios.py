"""The reference's documented example requests, expressed with tableops on invented
quarterly-sales and regional-sales sheets (FIXTURES A2/A3 shapes)."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

import tableops as to


@pytest.fixture(scope="module")
def sales(spark):
    rows = [("Widget", 10.0, 12.0, 9.0, 14.0, 45.0, 900.0, 700.0),
            ("Gadget", 5.0, None, 7.0, 8.0, 20.0, 400.0, 450.0),
            ("Gizmo", 20.0, 22.0, 25.0, 30.0, 97.0, 1940.0, 1200.0),
            ("Doohickey", 1.0, 2.0, 3.0, 4.0, 10.0, 150.0, 180.0),
            ("Thing", 8.0, 8.0, 8.0, 8.0, 32.0, 640.0, 500.0),
            ("Whatsit", 3.0, 6.0, 9.0, 12.0, 30.0, 600.0, 610.0)]
    return spark.createDataFrame(rows, "Product string, Q1 double, Q2 double, Q3 double, "
                                       "Q4 double, Sales double, Revenue double, Cost double")


@pytest.fixture(scope="module")
def regional(spark):
    d = dt.date
    rows = [("North", "c1", "Ann Lee", 100.0, 3.0, d(2024, 1, 1), "Active"),
            ("North", "c1", "Ann Lee", 100.0, 3.0, d(2024, 1, 1), "Active"),
            ("South", "c2", "Bo Chen", -20.0, 1.0, d(2024, 1, 1), "Closed"),
            ("South", "c3", "Cy Dee", 50.0, 2.0, d(2024, 2, 1), "Active"),
            ("East", "c4", "Di Fox", 75.0, 4.0, d(2024, 2, 1), "Pending")]
    return spark.createDataFrame(rows, "region string, customer string, full_name string, "
                                       "revenue double, sales double, month date, Status string")


def test_total_by_summing_quarters(sales):
    out = {r.Product: r.Total for r in to.calc(sales, "sum", ["Q1", "Q2", "Q3", "Q4"], "Total").collect()}
    assert out["Widget"] == 45.0 and out["Gadget"] == 20.0  # the missing Q2 counts as 0


def test_profit_and_margin(sales):
    p = sales.withColumn("Profit", F.col("Revenue") - F.col("Cost"))
    m = to.calc(p, "percentage", ["Profit", "Revenue"], "Margin")
    got = {r.Product: round(r.Margin, 4) for r in m.collect()}
    assert got["Widget"] == round(200 / 900 * 100, 4) and got["Gadget"] == round(-50 / 400 * 100, 4)


def test_top5_sort_and_average(sales):
    top = [r.Product for r in to.top_k(sales, "Revenue", 5).collect()]
    assert top == ["Gizmo", "Widget", "Thing", "Whatsit", "Gadget"]
    assert [r.Product for r in to.sort_rows(sales, "Sales", desc=True).collect()][0] == "Gizmo"
    avg = to.column_stat(sales, ["Q1", "Q2", "Q3", "Q4", "Sales", "Revenue", "Cost"], "mean").first()
    assert avg.Q2 == pytest.approx((12 + 22 + 2 + 8 + 6) / 5)


def test_bar_pie_kpi(sales, regional):
    bar = {r.Product: r.value for r in to.chart_series(sales, "Product", "Revenue").collect()}
    assert bar["Gizmo"] == 1940.0
    pie = to.pie_shares(regional, "region", "sales").collect()
    assert sum(r.share for r in pie) == pytest.approx(100.0, abs=0.2)
    k = {r.metric: r.value for r in to.kpi(sales, {"revenue": ("Revenue", "sum"),
                                                   "products": ("Product", "count")}).collect()}
    assert k == {"revenue": 4630.0, "products": 6.0}
    monthly = [(r.month, r.sales) for r in to.line_series(regional, "month", "sales").collect()]
    assert monthly == [(dt.date(2024, 1, 1), 7.0), (dt.date(2024, 2, 1), 6.0)]


def test_pivot_dedup_split(regional):
    p = {r.region: r.asDict() for r in
         to.pivot_table(regional, "region", "Status", "revenue", "sum").collect()}
    assert p["North"]["Active"] == 200.0 and p["North"]["Closed"] == 0.0
    d = to.deduplicate(regional, ["customer"], order_by=["month"]).count()
    assert d == 4
    s = to.split_column(regional, "full_name", ["first", "last"]).select("first", "last").first()
    assert (s.first, s.last) == ("Ann", "Lee")


def test_dropdown_highlight_duplicates(regional, sales):
    bad = to.check_allowed(regional, "Status", "Active, Closed", key="customer").collect()
    assert [(r.row_key, r.value) for r in bad] == [("c4", "Pending")]
    neg = {r.customer: r.neg for r in to.flag(regional, "revenue", "<", 0, "neg").collect()}
    assert neg["c2"] is True and neg["c3"] is False
    dups = to.check_unique(regional, ["customer"], key="customer").collect()
    assert sorted(r.row_key for r in dups) == ["c1", "c1"]
    red = to.color_when(sales, "Revenue", "<", 200, "fill", "FF0000").filter("fill IS NOT NULL")
    assert [r.Product for r in red.collect()] == ["Doohickey"]


def test_remove_column_and_lookup(sales, spark):
    assert "Cost" not in to.remove_column(sales, "Cost").columns
    prices = spark.createDataFrame([("Widget", 9.5), ("Gizmo", 20.0), ("Widget", 9.9)],
                                   "Product string, price double").withColumn("pos", F.monotonically_increasing_id())
    looked = {r.Product: r.price for r in
              to.lookup(sales, prices.coalesce(1), "Product", "price", "price", order_by=["pos"]).collect()}
    assert looked["Widget"] == 9.9 and looked["Gadget"] is None
