"""Plan shape: pushdown and pruning reach the scan, no cartesian products, no
windows without partition keys, scalars stay subqueries."""

import pytest

import __spark_entry__ as E
from tableops.plans.inspect import (
    has_cartesian, has_unpartitioned_window, plan_text, pushed_filters, read_schemas,
)
from tests.conftest import SF_SMALL

PLANNED = list(E.queries())


@pytest.mark.parametrize("name", PLANNED)
def test_no_cartesian_or_global_window(spark, name):
    df = E.queries()[name](spark, SF_SMALL)
    assert not has_cartesian(df), name
    assert not has_unpartitioned_window(df), name


def test_filter_pushed_and_columns_pruned(spark):
    df = E.queries()["filter_ge"](spark, SF_SMALL)
    assert any("GreaterThanOrEqual(l_quantity,30.0)" in p for p in pushed_filters(df))
    projected = df.select("l_orderkey")
    assert any("GreaterThanOrEqual(l_quantity,30.0)" in p for p in pushed_filters(projected))
    assert all("l_discount" not in s for s in read_schemas(projected))


def test_group_by_partial_aggregation(spark):
    t = plan_text(E.queries()["group_sum"](spark, SF_SMALL), "simple")
    assert "partial_sum" in t and t.count("Exchange hashpartitioning") == 1


def test_pct_of_total_uses_scalar_subquery(spark):
    t = plan_text(E.queries()["pct_of_total"](spark, SF_SMALL))
    assert "Subquery" in t and "Join" not in t


def test_dedup_uses_group_limit(spark):
    t = plan_text(E.queries()["dedup_first"](spark, SF_SMALL))
    assert "WindowGroupLimit" in t


def test_top_k_is_take_ordered(spark):
    t = plan_text(E.queries()["top_k"](spark, SF_SMALL))
    assert "TakeOrderedAndProject" in t
