"""Property tests: invariants of lookups, shares, subtotals, dedup, pivot round trip,
and the fuzzy matcher's exact blocking against brute force."""

import random

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

import tableops as to

SETTINGS = settings(max_examples=8, deadline=None)


def f8(term, value):
    """Plain-Python statement of the F8 rule used as the brute-force reference."""
    s = " ".join((term or "").split()).lower()
    v = " ".join((value or "").split()).lower()
    if not s or not v:
        return False
    if s in v or v in s:
        return True
    for w in v.replace("(", " ").replace(")", " ").split():
        if s in w or w in s:
            return True
        if len(s) >= 3 and len(w) >= 3 and s[:3] == w[:3]:
            return True
    return any(t in u for t in s.split() for u in v.split())


def way(s, v):
    """Number of the best way in which the texts match, None if they do not."""
    words = v.replace("(", " ").replace(")", " ").split()
    ways = [s == v, s in v, v in s, any(t in v for t in s.split()), any(w in s for w in words),
            len(s) >= 3 and any(len(w) >= 3 and w[:3] == s[:3] for w in words)]
    return ways.index(True) + 1 if True in ways and s and v else None


words = st.text(alphabet="abcde (", min_size=0, max_size=9)


@SETTINGS
@given(st.lists(words, min_size=1, max_size=12), st.lists(words, min_size=1, max_size=12))
def test_fuzzy_match_equals_brute_force(spark, terms, values):
    left = spark.createDataFrame([(i, t) for i, t in enumerate(terms)], "id int, t string")
    ref = spark.createDataFrame([(v,) for v in values], "v string")
    got = {r.id: (r.m, r.way) for r in to.fuzzy_match(left, ref, "t", "v", "m", tier="way").collect()}
    plain = {v: " ".join(v.split()).lower() for v in values}
    for i, t in enumerate(terms):
        s = " ".join(t.split()).lower()
        assert all((way(s, n) is not None) == f8(t, v) for v, n in plain.items())
        cands = [(way(s, n), len(n), n, v) for v, n in plain.items() if way(s, n)]
        assert got[i] == ((min(cands)[3], min(cands)[0]) if cands else (None, None)), t


@SETTINGS
@given(st.lists(st.tuples(words, words), min_size=1, max_size=20))
def test_token_match_expression_equals_rule(spark, pairs):
    df = spark.createDataFrame(pairs, "a string, b string")
    got = [r.m for r in df.select(to.token_match(F.col("a"), F.col("b")).alias("m")).collect()]
    assert got == [f8(a, b) for a, b in pairs]


keys = st.sampled_from(["a", "b", "c", None])


@SETTINGS
@given(st.lists(st.tuples(keys, st.integers(-5, 5)), min_size=1, max_size=25))
def test_lookup_keeps_rows_and_dedup_unique(spark, data):
    df = spark.createDataFrame([(i, k, v) for i, (k, v) in enumerate(data)], "pos int, k string, v int")
    out = to.lookup(df, df, "k", "v", "got", order_by=["pos"])
    assert out.count() == len(data)
    last = {}
    for k, v in data:
        last[k] = v
    assert all(r.got == last[r.k] for r in out.collect())
    d = to.deduplicate(df, ["k"], order_by=["pos"]).collect()
    assert len({r.k for r in d}) == len(d) == len({k for k, _ in data})


@SETTINGS
@given(st.lists(st.tuples(st.sampled_from(["x", "y", "z"]), st.floats(0, 100, allow_nan=False)),
                min_size=1, max_size=25))
def test_pie_shares_and_subtotals(spark, data):
    df = spark.createDataFrame(data, "k string, v double")
    shares = [r.share for r in to.pie_shares(df, "k", "v").collect()]
    if sum(v for _, v in data) > 0:
        assert abs(sum(shares) - 100) <= 0.05 * len(shares) + 1e-9
    sub = to.subtotals(df, "k").collect()
    sums = {}
    for k, v in data:
        sums[k] = sums.get(k, 0.0) + v
    got = {r.k.replace(" - SUBTOTAL", ""): r.v for r in sub if r._is_subtotal}
    assert got.keys() == sums.keys()
    assert all(abs(got[k] - sums[k]) < 1e-6 for k in sums)


def test_pivot_unpivot_round_trip(spark):
    rnd = random.Random(3)
    data = [(f"r{i}", c, float(rnd.randint(1, 9))) for i in range(6) for c in ("p", "q", "s")]
    df = spark.createDataFrame(data, "i string, c string, v double")
    wide = to.pivot_table(df, "i", "c", "v", "sum", values=["p", "q", "s"])
    back = wide.unpivot("i", ["p", "q", "s"], "c", "v")
    assert sorted(tuple(r) for r in back.collect()) == sorted(data)


def test_row_index_is_dense_and_ordered(spark):
    df = spark.range(0, 5000, numPartitions=7).withColumn("k", (F.col("id") * 7919) % 5000)
    ix = to.with_row_index(df, ["k"])
    got = sorted((r.row_ix, r.k) for r in ix.collect())
    assert [r for r, _ in got] == list(range(5000))
    assert [k for _, k in got] == sorted(k for _, k in got)


@SETTINGS
@given(st.lists(st.tuples(st.sampled_from(["hot", "hot", "hot", "a", "b"]),
                          st.one_of(st.none(), st.integers(-50, 50).map(float))),
                min_size=1, max_size=60))
def test_exact_quantiles_equal_pandas(spark, data):
    import pandas as pd
    from tableops.plans.quantiles import exact_quantiles
    df = spark.createDataFrame(data, "k string, v double")
    pdf = pd.DataFrame(data, columns=["k", "v"]).dropna()
    want = {k: tuple(g["v"].quantile([0.25, 0.5, 0.75]).tolist()) for k, g in pdf.groupby("k")}
    # all groups by percentile (default), hot groups split off (3), all groups by rank
    got = {r.k: (r.q0, r.q1, r.q2) for r in exact_quantiles(df, "v", [0.25, 0.5, 0.75], by=["k"]).collect()}
    assert set(got) == set(want)
    for k in want:
        assert all(abs(a - b) < 1e-9 for a, b in zip(got[k], want[k])), (k, got[k], want[k])
    overall = exact_quantiles(df, "v", [0.5]).collect()
    if len(pdf):
        assert abs(overall[0].q0 - pdf["v"].median()) < 1e-9
    else:
        assert overall == []


def test_scatter_sample_equals_brute_force(spark):
    """G4 picks the n rows with the smallest MD5 of seed and key."""
    import hashlib

    from tests.conftest import SF_SMALL

    def h(seed, key):
        return hashlib.md5(f"{seed}|{key}".encode()).hexdigest()

    o = to.read_table(spark, f"{SF_SMALL}/orders.parquet")
    got = sorted((r.o_orderdate, r.o_totalprice) for r in
                 to.scatter_points(o, "o_orderdate", "o_totalprice", n=50, seed=7, key=["o_orderkey"]).collect())
    rows = o.select("o_orderkey", "o_orderdate", "o_totalprice").collect()
    best = sorted(rows, key=lambda r: (h(7, r.o_orderkey), r.o_orderkey))[:50]
    assert got == sorted((r.o_orderdate, r.o_totalprice) for r in best)


@SETTINGS
@given(st.lists(st.tuples(st.one_of(st.none(), st.integers(-1000, 1000)),
                          st.one_of(st.none(), st.floats(-1e3, 1e3, allow_nan=False))),
                min_size=2, max_size=40))
def test_summary_stats_equal_pandas_describe(spark, data):
    import pandas as pd
    df = spark.createDataFrame(data, "a long, b double")
    got = {r.Column: r.asDict() for r in to.summary_stats(df).collect()}
    pdf = pd.DataFrame(data, columns=["a", "b"]).astype("float64")
    for c in ["a", "b"]:
        d = pdf[c].describe()
        g = got[c]
        assert g["Count"] == int(d["count"])
        if d["count"] == 0:
            assert g["Mean"] is None
            continue
        for mine, theirs in [("Mean", "mean"), ("Min", "min"), ("25%", "25%"), ("50%", "50%"),
                             ("75%", "75%"), ("Max", "max")]:
            assert abs(g[mine] - d[theirs]) <= 1e-9 * max(1.0, abs(d[theirs])), (c, mine, g[mine], d[theirs])
        if d["count"] > 1:
            assert abs(g["Std"] - d["std"]) <= 1e-6 * max(1.0, abs(d["std"]))
        else:
            assert g["Std"] is None
