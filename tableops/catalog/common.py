"""Shared helpers for the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tableops.sources.io import read_table


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, f"{sf_dir.rstrip('/')}/{name}.parquet")


class Registry:
    def __init__(self):
        self.queries: dict = {}
        self.sql: dict = {}

    def add(self, name: str, sql: str | None = None):
        def deco(fn):
            self.queries[name] = fn
            if sql is not None:
                self.sql[name] = sql
            return fn
        return deco
