"""Registered queries: one Spark query per operator over the driver tables, with
the DuckDB SQL that must give the same rows. Queries read whole tables."""

from __future__ import annotations

from tableops.catalog import (  # noqa: F401
    basic, aggregates, joins, checks, reports,
)


def all_queries() -> dict:
    out = {}
    for m in (basic, aggregates, joins, checks, reports):
        out.update(m.QUERIES)
    return out


def all_sql() -> dict:
    out = {}
    for m in (basic, aggregates, joins, checks, reports):
        out.update(m.SQL)
    return out
