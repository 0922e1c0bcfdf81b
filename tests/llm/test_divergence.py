"""Source divergence against plain sums over all terms and pairs."""

import random
import re
from collections import Counter, defaultdict

import pyarrow as pa

from tableops.llm import divergence


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], "text string, lang string, source string, term string, s string")


def plain(rows, least=10, top=10):
    docs = [(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if c < "\x80" else c for c in t or "")), a or "", b or "")
            for t, a, b in rows]
    out = []
    for lang in {a for _, a, _ in docs}:
        df, whole, by = Counter(), Counter(), defaultdict(Counter)
        for terms, a, b in docs:
            if a == lang:
                df.update(set(terms))
                whole.update(terms)
                by[b].update(terms)
        kept = {t for t, n in df.items() if n >= least}

        def shares(counts):
            total = sum(counts[t] for t in kept)
            return {t: 1 + 10 ** 9 * (counts[t] + 2) // (total + 2 * len(kept)) for t in kept}
        q, p = shares(whole), {b: shares(c) for b, c in by.items()}

        def apart(x, y):
            return (x - y) ** 2 // (x + y)
        for b in by:
            pairs = [(o, sum(apart(p[b][t], p[o][t]) for t in kept)) for o in by if o != b]
            terms = [(t, apart(p[b][t], q[t])) for t in kept if by[b][t] and p[b][t] > q[t]]
            for part, items, most in (("pair", pairs, None), ("term", terms, top)):
                ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most]
                out += [(lang, b, part, i, v, k) for k, (i, v) in enumerate(ranked, 1)]
    return sorted(out)


def test_divergence(spark):
    r = random.Random(3)
    stock = ["alpha", "Beta", "gämma", "ÄÖ", "日本", "d", "naïve", "x y"]
    rows = [(" ".join(r.choice(stock[:r.randint(1, 8)]) + r.choice(["", ",", "1", "_"]) for _ in range(r.randint(0, 60))),
             r.choice(["en", "de", None]), r.choice(["a", "b", "ä", "c c", None])) for _ in range(160)]
    rows += [(None, "en", "empty"), ("", "fr", "only"), ("alone", "xx", "one"), ("alone", "xx", "two")] + rows[:5]
    rows += [("tie tie " * 400, "en", "a")] * 12
    got = sorted(tuple(x) for x in divergence.source_divergence(frame(spark, rows)).select(
        "lang", "source", "part", "item", "value", "rank").collect())
    assert got == plain(rows)
    assert any(x[4] for x in got if x[2] == "pair") and any(x[0] == "xx" and x[4] == 0 for x in got)
    assert divergence.source_divergence(frame(spark, [])).collect() == []


def test_tree_takes_each_pair_of_a_path_once_and_cut_paths_add_up():
    r = random.Random(5)
    zeros = {s: 1000 + s for s in range(6)}
    rows = []
    for _ in range(300):
        row = [dict(s=s, n=n, p=2000 + 700 * n + s, z=zeros[s]) for s in range(6) if (n := r.choice([0, 0, 1, 2]))]
        if row:
            rows.append((r.choice(["", "en"]), row, r.randint(1, 4)))
    rows.sort(key=lambda x: (x[0], [tuple(y.values()) for y in x[1]]))
    want = Counter()
    f = lambda p, q: (p - q) ** 2 // (p + q)
    for lang, row, m in rows:
        for i, a in enumerate(row):
            for b in row[i + 1:]:
                want[lang, a["s"], b["s"]] += m * (f(a["p"], b["p"]) - f(a["p"], b["z"]) - f(a["z"], b["p"]) + f(a["z"], b["z"]))
    kind = pa.list_(pa.struct([(c, pa.int64()) for c in "snpz"]))
    for cut in (len(rows), 50, 7):
        got = Counter()
        for k in range(0, len(rows), cut):
            some = list(zip(*rows[k:k + cut]))
            batch = pa.RecordBatch.from_arrays([pa.array(some[0]), pa.array(some[1], kind), pa.array(some[2], pa.int64())], ["lang", "row", "m"])
            for out in divergence._corrected(iter([batch.slice(0, 3), batch.slice(3)])):
                for x in out.to_pylist():
                    got[x["lang"], x["s"], x["t"]] += x["v"]
        assert {k: v for k, v in got.items() if v} == {k: v for k, v in want.items() if v}
