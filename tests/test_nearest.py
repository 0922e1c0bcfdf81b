"""Nearest spelling and containment at any length against brute force."""

import random

import pytest
from pyspark.sql import functions as F

import tableops as to
from tableops.operators.lookup import occurrences


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def norm(t):
    return " ".join((t or "").split()).lower()


def nearest(term, values, most):
    term = norm(term)
    found = [(distance(term, norm(v)), len(norm(v)), norm(v), v) for v in values if norm(v) and term]
    best = min((x for x in found if x[0] <= most), default=None)
    return best and (best[3], best[0])


@pytest.mark.parametrize("most, hot", [(0, 20_000), (1, 20_000), (2, 20_000), (2, 0), (1, 0), (3, 5)])
def test_nearest_match(spark, most, hot):
    r = random.Random(most)
    values = ["".join(r.choice("abé ") for _ in range(r.randint(0, 9))) for _ in range(60)]
    values += [f"Key#0000{k}" for k in range(30)] + [None, "", "A", "a", "ab"]
    terms = ["".join(r.choice("abé ") for _ in range(r.randint(0, 9))) for _ in range(60)] + [None, "", "key#00012", "Ky#00007 ", "key#0000099", "b"]
    df = spark.createDataFrame(list(enumerate(terms)) + [(900, "key#00012")], "id int, t string")
    ref = spark.createDataFrame([(v,) for v in values], "v string")
    got = {x.id: x.m and (x.m, x.d) for x in to.nearest_match(df, ref, "t", "v", "m", most, "d", hot_pairs=hot).collect()}
    assert got == {**{k: nearest(t, values, most) for k, t in enumerate(terms)}, 900: nearest("key#00012", values, most)}


def test_nearest_match_without_values(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, None)], "id int, t string")
    ref = spark.createDataFrame([], "v string")
    assert [x.m for x in to.nearest_match(df, ref, "t", "v", "m").collect()] == [None] * 3
    assert to.nearest_match(df.limit(0), ref, "t", "v", "m").collect() == []
    with pytest.raises(ValueError):
        to.nearest_match(df, ref, "t", "v", "m", max_edits=-1)


def test_hot_part_is_split(spark):
    """4,000 keys of one beginning against as many misspelt ones: candidates stay few."""
    ref = spark.range(4000).select(F.format_string("customer number %05d", "id").alias("v"))
    df = spark.range(4000).select("id", F.format_string("customer nmber %05d", "id").alias("t"))
    out = to.nearest_match(df, ref, "t", "v", "m", max_edits=1, distance="d")
    assert out.filter((F.col("m") != F.format_string("customer number %05d", "id")) | (F.col("d") != 1) | F.col("m").isNull()).count() == 0


def test_occurrences(spark):
    r = random.Random(1)
    texts = ["".join(r.choice("abc") for _ in range(r.randint(0, 40))) for _ in range(80)] + ["aaaa", ""]
    keys = list({"".join(r.choice("abc") for _ in range(r.randint(1, 20))) for _ in range(80)} | {t[3:25] for t in texts if len(t) > 25} | {"zz", "aaaaa"})
    got = occurrences(spark.createDataFrame([(k,) for k in keys], "_key string"),
                      spark.createDataFrame(list(enumerate(texts)), "id int, x string"), "x").collect()
    assert sorted((x.id, x._key) for x in got) == sorted((i, k) for i, t in enumerate(texts) for k in keys if k in t)


def test_entries_are_linear_in_the_text(spark):
    keys = spark.range(1, 200).select(F.repeat(F.lit("ab"), F.col("id").cast("int")).alias("_key"))
    text = spark.range(1).select(F.concat(*[F.format_string("%05d", F.lit(k)) for k in range(400)]).alias("x"))
    plan = occurrences(keys, text, "x")
    assert plan.count() == 0
    sizes = keys.select(F.collect_set(F.call_function("shiftleft", F.lit(1), F.floor(F.log2(F.length("_key") + 0.5)).cast("int"))).alias("s")).first().s
    assert sorted(sizes) == [2, 4, 8, 16, 32, 64, 128, 256]


def test_nothing_is_broadcast_by_the_size_of_the_file(spark, scratch):
    """20,000 keys that compress well: a file of few KB, whose parts must not go through the driver."""
    spark.range(20_000).select(F.format_string("customer number %09d", "id").alias("v")).coalesce(1).write.parquet(f"{scratch}/v")
    ref = spark.read.parquet(f"{scratch}/v")
    out = to.nearest_match(ref.select(F.expr("replace(v, 'num', 'nm')").alias("t")), ref, "t", "v", "m", max_edits=1, distance="d")
    joins = [x for x in out._jdf.queryExecution().executedPlan().toString().split("\n") if "BroadcastHashJoin" in x]
    assert all("LeftAnti" in x or "LeftSemi" in x for x in joins)  # those with the hot parts, which were counted
    assert out.filter("m != replace(t, 'nm', 'num') or m is null or d != 1").count() == 0
