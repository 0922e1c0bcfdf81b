"""Periodic runs against a search over all lags, and the query against its contract."""

import hashlib
import random
import zlib

import pytest

from tableops.llm import periodic
from tableops.llm.catalog import R
from tests.llm.brute import words
from tests.llm.test_operators import table


def all_runs(w):
    out = []
    for p in range(1, len(w) // 4 + 1):
        i = 0
        while i + p < len(w):
            j = i
            while j + p < len(w) and w[j] == w[j + p]:
                j += 1
            if j > i and j - i + p >= max(6, 4 * p) and not any(
                    all(w[k] == w[k + d] for k in range(i, j + p - d)) for d in range(1, p)):
                out.append((i, j - i + p, p))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def outside(w, runs):
    gone = {k for s, n, p in runs for k in range(s + p, s + n)}
    return " ".join(x for k, x in enumerate(w) if k not in gone)


def patched(r, n, letters):
    w = [str(r.randrange(letters)) for _ in range(n)]
    for _ in range(r.randint(0, 3)):
        s, p = r.randrange(n), r.choice([1, 2, 3, 7, 31, 32, 33, 60])
        for i in range(s + p, min(n, s + r.randint(p, 9 * p))):
            w[i] = w[i - p]
    return w


def test_runs_of_many_texts_at_once():
    r = random.Random(4)
    for _ in range(120):
        texts = [patched(r, r.choice([1, 5, 6, 30, 150, 500]), r.choice([1, 2, 3, 9, 80])) for _ in range(r.randint(1, 8))] + [[]]
        number = {}
        flat = [number.setdefault(x, len(number)) for w in texts for x in w]
        assert periodic.find_runs(flat, [len(w) for w in texts]) == [all_runs(w) for w in texts]


@pytest.mark.parametrize("word", [[0] * 200_000, [0, 1] * 100_000, list(range(40_000)) * 5])
def test_very_long_texts_are_not_quadratic(word):
    period = len(set(word))
    assert periodic.find_runs(word, [len(word)]) == [[(0, len(word), period)]]


def test_operator_on_awkward_rows(spark):
    r = random.Random(9)
    rows = [(1, None), (2, ""), (3, " \n\t\x0b "), (None, "a a a a a a"), (4, "a a a a a"), (4, "a a a a a"),
            (5, "b\x1cb " * 6), (6, "é a " * 5 + "x y z " * 4), (7, " ".join(["w"] * 50_000))]
    rows += [(10 + k, "\n".join(patched(r, 120, 3))) for k in range(20)]
    got = periodic.periodic_runs(table(spark, rows)).collect()
    want = []
    for k, t in rows:
        w = words(t)
        runs = all_runs(w) if len(w) < 1000 else [(0, len(w), 1)]
        top = max(runs, key=lambda x: (x[1] / x[2], -x[0], -x[2]), default=None)
        want.append((k, len(w), runs, top, outside(w, runs)))
    got = [(x.doc_id, x.n_words, [tuple(y) for y in x.runs], x.strongest and tuple(x.strongest), x.collapsed) for x in got]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert periodic.periodic_runs(table(spark, []).select("doc_id", "text")).collect() == []


def test_equal_exponents_go_to_the_first():
    assert periodic.strongest([(0, 9, 2), (5, 18, 4), (30, 9, 2)]) == (0, 9, 2)
    assert periodic.strongest([(5, 18, 4), (5, 9, 2)]) == (5, 18, 4)


def test_query(spark, scratch):
    r = random.Random(2)
    rows = [(k, " ".join(patched(r, r.choice([1, 8, 40, 200]), r.choice([2, 5, 40])))) for k in range(80)]
    rows += [(200, None), (201, ""), (None, "a b c d e f g h"), (12, "one  two\tthree " * 9)]
    table(spark, rows).write.parquet(f"{scratch}/documents.parquet")
    got = R.queries["op11_periodic_runs"](spark, scratch).collect()
    want = []
    for k, t in rows:
        w, h = words(t), zlib.crc32(("" if k is None else str(k)).encode())
        g, n = h // 10, len(w)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        runs = all_runs(w)
        best = None
        for s, length, q in runs:
            if best is None or length * best[2] > best[1] * q:
                best = s, length, q
        sha = [hashlib.sha256(x.encode()).hexdigest() for x in ("".join(f"{a},{b},{c}\n" for a, b, c in runs), outside(w, runs))]
        want.append((k, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], *sha))
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert any(x[1] for x in want if x[0] is not None and zlib.crc32(str(x[0]).encode()) % 10 == 0)
