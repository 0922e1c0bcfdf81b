"""The recurrent network: gradients against differences, held-out accuracy, awkward rows."""

import random
import zlib

import numpy as np

from tableops.llm import toxicity

CLEAN = "the of and to in is was for on with as by at from it an be this that are".split()
BAD = ["gromful", "gromish", "gromest", "vilk", "vilker"]


def prose(r, n, bad):
    return " ".join(r.choice(BAD) if bad and r.random() < 0.05 else r.choice(CLEAN) + r.choice(["", "ing", "s"]) for _ in range(n))


def rows(n):
    r = random.Random(7)
    return [(k, prose(r, r.randint(20, 200), k % 4 == 0), int(k % 4 == 0)) for k in range(n)]


def test_windows_overlap_and_hold_every_word():
    for n in (0, 1, 31, 32, 33, 48, 49, 500):
        starts = list(toxicity.window_starts(n))
        assert starts[0] == 0 and {k for s in starts for k in range(s, s + toxicity.WINDOW)} >= set(range(n))
        assert all(b - a < toxicity.WINDOW for a, b in zip(starts, starts[1:])) and (len(starts) == 1 or starts[-1] < n)


def test_gradients():
    r = np.random.default_rng(1)
    inputs = toxicity.Inputs()
    numbers = [inputs.numbers(toxicity.words_of(t)) for t in ("a bc def ghij a", "x " * 40, "")]
    at = np.array([w for x in numbers for w in toxicity.cut_windows(x)]).T
    label, table = np.array([1, 0, 0, 1], np.float32)[:at.shape[1]], tuple(np.array(x) for x in (inputs.word, inputs.chars, inputs.many))
    q = {k: v.astype(np.float64) for k, v in toxicity._fresh().items()}
    blind = np.ones(len(table[0]))
    grad = toxicity._gradients(q, table, at, label, blind)

    def loss():
        given = toxicity._vectors(q, *table).astype(np.float64) @ q["into"] + q["shift"]
        x = toxicity._read(q, given, at)[0]
        return float(np.mean(np.log1p(np.exp(x)) - label * x))
    for name in ("into", "shift", "again", "look", "out", "level"):
        for _ in range(4):
            where = tuple(r.integers(0, d) for d in q[name].shape)
            keep, e = q[name][where], 1e-3
            q[name][where] = keep + e
            up = loss()
            q[name][where] = keep - e
            slope = (up - loss()) / (2 * e)
            q[name][where] = keep
            assert abs(slope - grad[name][where]) < 1e-4 + 0.02 * abs(slope), name


def test_held_out_accuracy_and_awkward_rows(spark):
    known = rows(600)
    odd = [(9001, None), (9002, ""), (None, "vilk gromful " * 30), (9003, "of the " * 30_000), (9003, "of the " * 30_000)]
    docs = spark.createDataFrame([(k, t, "x") for k, t, _ in known] + [(*x, "x") for x in odd], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(k, y, 1) for k, _, y in known] + [(None, 1, 1), (9003, None, 1)], "doc_id long, toxic int, quality int")
    out = toxicity.toxicity(docs, labels).collect()
    assert len(out) == len(known) + len(odd)
    truth = {k: y for k, _, y in known}
    held = [x for x in out if x.held_out and x.doc_id in truth]
    assert all(x.held_out == (x.doc_id is not None and zlib.crc32(str(x.doc_id).encode()) % 3 == 1) for x in out)
    assert len(held) > 100 and np.mean([x.predicted == truth[x.doc_id] for x in held]) > 0.95
    assert all(0 <= x.score <= 1 and x.predicted == (x.score >= 0.7) for x in out)
    by = {x.doc_id: x for x in out}
    assert by[9001].score == by[9002].score and by[9003].predicted == 0 and by[None].predicted == 1
    texts = toxicity.training_rows(docs, labels, "doc_id", "text", "toxic")
    assert {t for t, _ in texts} == {t for k, t, _ in known if zlib.crc32(str(k).encode()) % 3 != 1}
    assert {x.score for x in toxicity.toxicity(docs, labels.limit(0)).collect()} == {0.0}
    assert toxicity.toxicity(docs.limit(0), labels).collect() == []
