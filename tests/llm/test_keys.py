"""Joins with tables of keys: what the broadcast bits leave out, and that no result depends on them."""

import random

import pytest
from pyspark.sql import functions as F

from tableops.llm import common, lines, links, near
from tests.llm import brute
from tests.llm.test_operators import prose, same, table


@pytest.fixture()
def few(monkeypatch):
    """As on large tables: next to nothing may be broadcast but bits."""
    for module, name, most in ((common, "SMALL", 9), (lines, "SMALL", 9), (lines, "SMALL_LISTS", 2)):
        monkeypatch.setattr(module, name, most)
    monkeypatch.setattr(common.checked_broadcast, "__defaults__", (None, 9))


def test_bits_let_all_keys_through_and_few_others(spark, few):
    some = common.keys(spark.range(1000).select(F.col("id").alias("k"), (-F.col("id")).alias("m")), ["k", "m"])
    assert some.bits is not None and some.blocks == 8
    rows = spark.range(20_000).select(F.col("id").alias("a"), (-F.col("id")).alias("b"))
    left = {x.a for x in common.thin(rows, ["a", "b"], some).collect()}
    assert left >= set(range(1000)) and len(left) < 1000 + 0.1 * 19_000
    assert {x.a for x in common.meet(rows, ["a", "b"], some).collect()} == set(range(1000))
    every = common.meet_left(rows, ["a", "b"], some, F.col("a") != 5).collect()
    assert {x.a: x.k for x in every} == {a: a if a < 1000 and a != 5 else None for a in range(20_000)} and len(every) == 20_000


def test_many_keys_do_without_bits(spark, few):
    some = common.keys(spark.range(2000).select(F.col("id").alias("k")), ["k"])
    assert some.bits is None
    rows = spark.range(3000).select(F.col("id").alias("a"))
    assert common.meet(rows, ["a"], some).count() == 2000 and common.meet_left(rows, ["a"], some).filter("k is null").count() == 1000


def test_equal_keys_are_combined_before_they_are_dealt_out(spark, few):
    """200 keys of 300 rows each in one partition: one row of each that may be wanted is dealt out, once, and joined there."""
    some = common.keys(spark.range(100).select(F.col("id").alias("k")), ["k"])
    assert some.bits is not None
    rows = spark.range(60_000, numPartitions=1).select((F.col("id") % 200).alias("a"), F.concat(F.lit("t"), F.col("id") % 200).alias("t"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = common.meet_first(rows, ["a"], some, "t")
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert sorted((x.a, x.t) for x in got.collect()) == [(a, f"t{a}") for a in range(100)]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.index("LeftSemi") < plan.index("Aggregate") < plan.index("partial_first")
    assert plan.count("Exchange hashpartitioning(") == 2  # of the texts and of the keys


def test_operators_by_bits(spark, few):
    r = random.Random(4)
    texts = []
    for k in range(40):
        body = [prose(r, 30) for _ in range(3)]
        texts += ["\n".join(body), "\n".join([body[0][:-1] + "#", prose(r, 30)])] if k % 2 else ["\n".join(body), "\n".join(body)[:-2]]
    rows = [*enumerate(texts), (None, None), (3, texts[3]), (3, texts[4]), (None, texts[9])]
    gone = brute.removed_lines(rows)
    assert len(gone) > 10
    same([(x.doc_id, x.n_lines, list(x.removed)) for x in lines.line_dedup(table(spark, rows)).collect()],
         [(k, len((t or "").split("\n")), gone.get((k, t or ""), [])) for k, t in rows])
    cut = lines.drop_repeated_lines(table(spark, rows)).select("doc_id", "text").collect()
    same([tuple(x) for x in cut], [(k, "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone.get((k, t), ())) if t else t) for k, t in rows])
    classes = {}
    for c, (k, t) in zip(brute.near_class(rows), rows):
        classes.setdefault(c, []).append(k)
    least = [min((k for k in x if k is not None), default=None) for x in classes.values()]
    same([(x.doc_id,) for x in near.keep_one(table(spark, rows)).collect()], [(k,) for k in least])


def test_of_buckets_with_the_same_members_one_is_used(spark, monkeypatch):
    """Ten buckets of the same three nodes, and one of two of them and a fourth."""
    used, central = [], links._central

    def seen(shared, *more):
        used.append(sorted((x.bucket, x.node.lo) for x in shared.collect()))
        return central(shared, *more)
    monkeypatch.setattr(links, "_central", seen)
    members = [(b, n) for b in range(10, 20) for n in (1, 2, 3)] + [(99, n) for n in (1, 2, 4)]
    shared = spark.createDataFrame([(b, (0, n)) for b, n in members], "bucket long, node struct<hi:long,lo:long>")
    info = spark.createDataFrame([((0, n), [b for b, m in reversed(members) if m == n]) for n in (1, 2, 3, 4)],
                                 "node struct<hi:long,lo:long>, bands array<long>")
    alike = F.col("a.lo") % 2 == F.col("b.lo") % 2
    got = links.linked(shared, lambda pairs: pairs.filter(alike), info).collect()
    assert used == [[(10, 1), (10, 2), (10, 3), (99, 1), (99, 2), (99, 4)]]
    assert {x.node.lo: x.root.lo for x in got} == {3: 1, 4: 2}
