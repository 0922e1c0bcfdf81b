"""Workbook versions: two writers, a failure half-way, uncommitted folders."""

from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

import tableops as to


def test_names_are_given_once(spark, tmp_path):
    with ThreadPoolExecutor(8) as pool:
        got = list(pool.map(lambda _: to.reserve_version(spark, str(tmp_path), "book"), range(40)))
    assert sorted(got) == sorted(f"{tmp_path}/book_modified_{n}" for n in range(1, 41))
    assert to.versions(spark, str(tmp_path), "book") == []


def test_two_writers(spark, tmp_path):
    book = {"a": spark.range(5), "b": spark.range(3)}
    with ThreadPoolExecutor(2) as pool:
        paths = list(pool.map(lambda n: to.save_version(book, "a", spark.range(n), str(tmp_path), "book"), (7, 8)))
    assert sorted(paths) == to.versions(spark, str(tmp_path), "book")
    for path, n in zip(paths, (7, 8)):
        saved = to.read_version(spark, path)
        assert {k: t.count() for k, t in saved.items()} == {"a": n, "b": 3}


def test_failure_half_way_leaves_no_version(spark, tmp_path):
    book = {"a": spark.range(5), "z": spark.range(2)}
    first = to.save_version(book, "a", spark.range(6), str(tmp_path), "book")
    broken = spark.range(4).select(F.raise_error(F.lit("broken")).cast("int").alias("id"))
    with pytest.raises(Exception, match="broken"):
        to.save_version(book, "z", broken, str(tmp_path), "book")
    half = f"{tmp_path}/book_modified_2"
    assert (tmp_path / "book_modified_2" / "a").exists() and to.versions(spark, str(tmp_path), "book") == [first]
    with pytest.raises(FileNotFoundError):
        to.read_version(spark, half)
    third = to.save_version(book, "a", spark.range(9), str(tmp_path), "book")
    assert third.endswith("book_modified_3") and to.versions(spark, str(tmp_path), "book") == [first, third]


def test_other_folders_are_no_versions(spark, tmp_path):
    (tmp_path / "book_modified_4").mkdir()
    (tmp_path / "book_modified_x").mkdir()
    (tmp_path / "bookkeeping_modified_9").mkdir()
    assert to.reserve_version(spark, str(tmp_path), "book").endswith("book_modified_5")
    assert to.versions(spark, str(tmp_path), "book") == []
