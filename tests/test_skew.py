"""Hot keys: one key holds ~40% of the rows. Results must stay exact and whole."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

import tableops as to


@pytest.fixture(scope="module")
def skewed(spark):
    rnd = random.Random(5)
    rows = []
    for i in range(4000):
        k = "HOT" if i % 5 < 2 else f"k{rnd.randint(0, 300)}"
        rows.append((i, k, float(rnd.randint(0, 10_000)) / 100, f"name {rnd.randint(0, 50)}"))
    return spark.createDataFrame(rows, "pos long, k string, v double, t string").repartition(8), rows


def test_dedup_and_lookup_under_skew(spark, skewed):
    df, rows = skewed
    first = {}
    last = {}
    for pos, k, v, _ in rows:
        first.setdefault(k, pos)
        last[k] = v
    d = to.deduplicate(df, ["k"], order_by=["pos"]).collect()
    assert {r.k: r.pos for r in d} == first
    got = to.lookup(df.select("pos", "k"), df, "k", "v", "last_v", order_by=["pos"]).collect()
    assert len(got) == len(rows) and all(r.last_v == last[r.k] for r in got)
    im = to.index_match(df, "k", "v", "last_v", order_by=["pos"]).collect()
    assert all(r.last_v == last[r.k] for r in im)


def test_unique_and_median_under_skew(spark, skewed):
    df, rows = skewed
    counts = {}
    for _, k, _, _ in rows:
        counts[k] = counts.get(k, 0) + 1
    dup_rows = sum(c for c in counts.values() if c > 1)
    assert to.check_unique(df, ["k"], key="pos").count() == dup_rows
    med = {r.k: r.v for r in to.group_by(df, "k", {"v": "median"}).collect()}
    hot = [v for _, k, v, _ in rows if k == "HOT"]
    assert med["HOT"] == pytest.approx(statistics.median(hot))
    assert len(med) == len(counts)


def test_sample_and_fuzzy_under_skew(spark, skewed):
    df, rows = skewed
    s = to.region_sample(df, ["pos"], 3).collect()
    assert sorted(r.pos for r in s if r.region == "middle") == [1999, 2000, 2001]
    ref = spark.createDataFrame([("name 7",), ("name 42",), ("label",)], "v string")
    m = to.fuzzy_match(df, ref, "t", "v", "m")
    assert m.count() == len(rows)
    assert m.filter(F.col("t") == "name 7").select("m").distinct().collect()[0].m == "name 7"


def test_session_enables_aqe_skew_handling(spark):
    assert spark.conf.get("spark.sql.adaptive.enabled") == "true"
    assert spark.conf.get("spark.sql.adaptive.skewJoin.enabled") == "true"
