"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained in numpy.

A text's words go through windows of WINDOW words, each beginning STEP words after the one
before, so that windows overlap and together hold every word. A word enters by two inputs:
its own vector (words hashed to a table) and the sum of the vectors of its character runs of
three to five (hashed to another, with a mark at both ends), so that new words of a known
stem are understood. Two gated recurrent chains read a window in both directions, attention
weighs the states of its words, and their weighted mean gives the window's logit. A document's
score is a logistic function of the mean and the greatest window probability and the number
of windows, fitted on the same documents.

Training sees labelled rows only, at most TRAIN_TOXIC toxic and TRAIN_CLEAN other ones, those of
the least hash, of at most TRAIN_CHARS characters each; they are collected to the driver, which
bounds its memory. Windows first inherit their document's label; later rounds take of a toxic
document the windows that score highest. The fitted arrays (about 1 MB) are broadcast, scoring
is independent by rows: there is no shuffle.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tableops.llm.common import by_value, pick, portions, whole_text, worker_store

WINDOW, STEP = 32, 16
TRAIN_TOXIC, TRAIN_CLEAN, TRAIN_CHARS = 1200, 2400, 20_000
ROUNDS, BATCH, BATCHES, RATE, DECAY = 8, 256, 60, 0.004, 0.002
#: Rows and width of the tables of word and character vectors; width of a recurrent state.
WORD_ROWS, CHAR_ROWS, WIDTH, STATE = 1 << 13, 1 << 14, 12, 16
CHAR_RUNS = (3, 4, 5)
TOXIC_FROM = 0.7
#: Characters that a Python worker takes up at once, windows scored at once, words kept.
AT_ONCE, WINDOWS_AT_ONCE, KEPT_WORDS = 1_000_000, 512, 400_000
WORD = re.compile(r"\w+")


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def window_starts(n: int) -> range:
    """Where the windows of ``n`` words begin; there is one at least."""
    return range(0, max(1, n - WINDOW + STEP), STEP)


def _rows_of(word: str) -> tuple[int, list[int]]:
    """The word's row in the word table and those of its character runs."""
    data = f"<{word}>".encode("utf-32-le", "surrogatepass")  # four bytes a character
    runs = [crc32(data[i:i + 4 * n]) % CHAR_ROWS for n in CHAR_RUNS for i in range(0, len(data) - 4 * n + 1, 4)]
    return crc32(word.encode("utf-8", "surrogatepass")) % WORD_ROWS, runs


class Inputs(dict):
    """Numbers of words, given when a word is first looked up, and the words' table rows.
    Number 0 stands for the place after a text's end."""

    def __init__(self):
        self.word, self.chars, self.many = array("i", [0]), array("i", [0]), array("i", [1])

    def __missing__(self, word: str) -> int:
        k = self[word] = len(self.word)
        row, runs = _rows_of(word)
        self.word.append(row)
        self.chars.extend(runs)
        self.many.append(len(runs))
        return k

    def numbers(self, words: list[str]) -> list[int]:
        return list(map(self.__getitem__, words))


def cut_windows(numbers: list[int]) -> list[list[int]]:
    return [numbers[s:s + WINDOW] + [0] * (WINDOW - len(numbers[s:s + WINDOW])) for s in window_starts(len(numbers))]


def _fresh() -> dict[str, np.ndarray]:
    r = np.random.default_rng(5)

    def drawn(*shape: int, by: float) -> np.ndarray:
        return (r.standard_normal(shape) * by).astype(np.float32)
    return {"word": drawn(WORD_ROWS, WIDTH, by=0.1), "char": drawn(CHAR_ROWS, WIDTH, by=0.1),
            "into": drawn(2, 2 * WIDTH, 3 * STATE, by=0.3), "shift": np.zeros((2, 1, 3 * STATE), np.float32),
            "again": drawn(2, STATE, 3 * STATE, by=0.2), "look": drawn(2 * STATE, by=0.2),
            "out": drawn(2 * STATE, by=0.2), "level": np.zeros(1, np.float32)}


def _vectors(q: dict, word: np.ndarray, chars: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Input vectors of words, from their table rows."""
    starts = np.cumsum(many) - many
    both = np.add.reduceat(q["char"][chars], starts, axis=0) / np.sqrt(many)[:, None]
    return np.concatenate([q["word"][word], both], axis=1).astype(np.float32)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return np.tanh(x * np.float32(0.5)) * np.float32(0.5) + np.float32(0.5)


def _read(q: dict, given: np.ndarray, at: np.ndarray, trace: list | None = None) -> tuple[np.ndarray, ...]:
    """Logits of windows ``at`` (WINDOW x windows; rows of ``given``, the words' gate inputs
    in both directions; row 0 is no word). ``trace`` takes what training needs of each step."""
    there = (at > 0).astype(np.float32)
    full = trace is None and bool(there.all())
    h = np.zeros((2, at.shape[1], STATE), np.float32)
    states = np.empty((WINDOW, 2, at.shape[1], STATE), np.float32)
    g = np.empty((2, at.shape[1], 3 * STATE), given.dtype)
    for t in range(WINDOW):
        u = WINDOW - 1 - t
        np.take(given[0], at[t], axis=0, out=g[0], mode="clip")  # all in range: no buffer
        np.take(given[1], at[u], axis=0, out=g[1], mode="clip")
        on = np.stack([there[t], there[u]])[:, :, None]
        a = h @ q["again"]
        gates = _sigmoid(g[..., :2 * STATE] + a[..., :2 * STATE])
        z, r = gates[..., :STATE], gates[..., STATE:]
        n = np.tanh(g[..., 2 * STATE:] + r * a[..., 2 * STATE:])
        if trace is not None:
            trace.append((h, z, r, n, a[..., 2 * STATE:], on))
        h = n + z * (h - n) if full else h + on * (n + z * (h - n) - h)
        states[t, 0], states[u, 1] = h[0], h[1]
    seen = np.concatenate([states[:, 0], states[:, 1]], axis=2)
    weight = np.exp(np.clip(seen @ q["look"], -30, 30)) * there + np.float32(1e-9)
    weight = weight / weight.sum(axis=0)
    pooled = (weight[:, :, None] * seen).sum(axis=0)
    return pooled @ q["out"] + q["level"], seen, weight, pooled


def _summed(rows: np.ndarray, index: np.ndarray, n: int) -> np.ndarray:
    """``n`` rows, each the sum of those ``rows`` that ``index`` sends to it."""
    order = np.argsort(index, kind="stable")
    ordered = index[order]
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    out = np.zeros((n, rows.shape[1]), dtype=np.float32)
    out[ordered[first]] = np.add.reduceat(rows[order], first, axis=0)
    return out


def _gradients(q: dict, rows: tuple, at: np.ndarray, label: np.ndarray, blind: np.ndarray) -> dict[str, np.ndarray]:
    """Gradients of the mean logistic loss; ``blind`` (1 or 0 a word) hides words' own vectors."""
    word, chars, many = rows
    vectors = _vectors(q, word, chars, many)
    vectors[:, :WIDTH] *= blind[:, None]
    given = vectors @ q["into"] + q["shift"]
    trace: list = []
    logit, seen, weight, pooled = _read(q, given, at, trace)
    d = (_sigmoid(logit) - label) / np.float32(len(label))
    g = {"level": d.sum(keepdims=True), "out": d @ pooled}
    d_pooled = d[:, None] * q["out"]
    d_weight = (seen * d_pooled).sum(axis=2)
    d_score = weight * (d_weight - (weight * d_weight).sum(axis=0))
    g["look"] = np.einsum("tb,tbk->k", d_score, seen)
    d_seen = weight[:, :, None] * d_pooled + d_score[:, :, None] * q["look"]
    d_h = np.zeros_like(trace[0][0])
    d_gates = np.empty((2, WINDOW, at.shape[1], 3 * STATE), np.float32)
    g["again"] = np.zeros_like(q["again"])
    for t in range(WINDOW - 1, -1, -1):
        u = WINDOW - 1 - t
        h, z, r, n, a, on = trace[t]
        d_h = d_h + np.stack([d_seen[t, :, :STATE], d_seen[u, :, STATE:]])
        d_new = d_h * on
        d_n = d_new * (1 - z) * (1 - n * n)
        d_z, d_r = d_new * (h - n) * z * (1 - z), d_n * a * r * (1 - r)
        d_in = np.concatenate([d_z, d_r, d_n], axis=2)
        d_a = np.concatenate([d_z, d_r, d_n * r], axis=2)
        g["again"] += h.transpose(0, 2, 1) @ d_a
        d_h = d_h - d_new + d_new * z + d_a @ q["again"].transpose(0, 2, 1)
        d_gates[0, t], d_gates[1, u] = d_in
    d_given = np.stack([_summed(x.reshape(-1, 3 * STATE), at.ravel(), len(word)) for x in d_gates])
    g["into"] = vectors.T @ d_given
    g["shift"] = d_given.sum(axis=1, keepdims=True)
    d_vectors = (d_given @ q["into"].transpose(0, 2, 1)).sum(axis=0)
    g["word"] = _summed(d_vectors[:, :WIDTH] * blind[:, None], word, WORD_ROWS)
    g["char"] = _summed(np.repeat(d_vectors[:, WIDTH:] / np.sqrt(many)[:, None], many, axis=0), chars, CHAR_ROWS)
    return g


def _window_odds(q: dict, rows: tuple, windows: np.ndarray) -> np.ndarray:
    """Probabilities of windows (windows x WINDOW), in blocks."""
    given = _vectors(q, *rows) @ q["into"] + q["shift"]
    order = np.argsort(windows[:, -1] == 0, kind="stable")  # full windows first: they need no mask
    out = np.empty(len(windows), dtype=np.float32)
    for k in range(0, len(windows), WINDOWS_AT_ONCE):
        some = order[k:k + WINDOWS_AT_ONCE]
        out[some] = _sigmoid(_read(q, given, np.ascontiguousarray(windows[some].T))[0])
    return out


def _document_facts(odds: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Per document: 1, log odds of the mean and of the greatest window, log of their number."""
    starts = np.cumsum(many) - many
    mean = np.add.reduceat(odds.astype(float), starts) / many
    top = np.maximum.reduceat(odds.astype(float), starts)

    def log_odds(x: np.ndarray) -> np.ndarray:
        x = np.clip(x, 1e-4, 1 - 1e-4)
        return np.log(x / (1 - x))
    return np.stack([np.ones(len(many)), log_odds(mean), log_odds(top), np.log(many)], axis=1)


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of a logistic function, by Newton steps with a small ridge."""
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        pull = x.T @ (p - y) + 0.02 * w
        w = w - np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.02 * np.eye(len(w)), pull)
    return w


def train(texts: list[str], labels: list[int]) -> dict[str, np.ndarray] | None:
    """The fitted arrays, or None if the labels are not of two kinds."""
    label = np.asarray(labels, dtype=np.float32)
    if len(set(labels)) < 2:
        return None
    inputs = Inputs()
    cut = [cut_windows(inputs.numbers(words_of(t))) for t in texts]
    many = np.array([len(c) for c in cut])
    windows = np.array([w for c in cut for w in c], dtype=np.int32)
    owner = np.repeat(np.arange(len(cut)), many)
    rows = tuple(np.array(x) for x in (inputs.word, inputs.chars, inputs.many))
    starts = np.cumsum(rows[2]) - rows[2]
    q = _fresh()
    r = np.random.default_rng(6)
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in q.items()}
    toxic, clean = [np.flatnonzero(label[owner] == k) for k in (1, 0)]
    step = 0
    for turn in range(ROUNDS):
        if turn >= 2:  # of each toxic document the higher third of its windows, and the highest
            odds = _window_odds(q, rows, windows)
            order = np.lexsort((-odds, owner))
            place = np.empty(len(odds), dtype=np.int64)
            place[order] = np.arange(len(odds)) - np.repeat(np.cumsum(many) - many, many)
            toxic = np.flatnonzero((label[owner] == 1) & (place <= np.maximum(0, many[owner] // 3 - 1)))
        for _ in range(BATCHES):
            some = np.concatenate([r.choice(toxic, BATCH // 2), r.choice(clean, BATCH // 2)])
            met, at = np.unique(windows[some].T, return_inverse=True)
            if met[0] != 0:  # word 0 keeps its place
                met, at = np.append(0, met), at + 1
            chars = np.concatenate([rows[1][starts[w]:starts[w] + rows[2][w]] for w in met])
            grad = _gradients(q, (rows[0][met], chars, rows[2][met]), at.reshape(WINDOW, BATCH), label[owner[some]],
                              (r.random(len(met)) < 0.6).astype(np.float32))
            step += 1
            rate = RATE * (1 - 0.8 * step / (ROUNDS * BATCHES))
            for k, g in grad.items():
                m, v = moment[k]
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                q[k] = (q[k] * (1 - DECAY) - rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-6)).astype(np.float32)
    facts = _document_facts(_window_odds(q, rows, windows), many)
    return q | {"document": _logistic(facts, label)}


class Scorer:
    """A fitted network with the words met so far."""

    def __init__(self, q: dict):
        self.q, self.inputs = q, Inputs()

    def scores(self, texts: list[str]) -> np.ndarray:
        if len(self.inputs.word) > KEPT_WORDS:
            self.inputs = Inputs()
        cut = [cut_windows(self.inputs.numbers(words_of(t))) for t in texts]
        many = np.array([len(c) for c in cut])
        windows = np.array([w for c in cut for w in c], dtype=np.int32)
        there = np.zeros(len(self.inputs.word), dtype=bool)
        there[windows.ravel()] = there[0] = True
        met, at = np.flatnonzero(there), (np.cumsum(there) - 1)[windows]
        # views of the words' arrays, which cannot grow before these are gone
        word, chars, each = (np.frombuffer(x, np.int32) for x in (self.inputs.word, self.inputs.chars, self.inputs.many))
        runs = each[met]
        place = np.repeat((np.cumsum(each) - each)[met] - (np.cumsum(runs) - runs), runs) + np.arange(runs.sum())
        odds = _window_odds(self.q, (word[met], chars[place], runs), at)
        return 1 / (1 + np.exp(-np.clip(_document_facts(odds, many) @ self.q["document"], -30, 30)))


def _third(key: Column) -> Column:
    """The remainder that deals rows to training (0, 2) and held-out (1)."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % 3


def training_rows(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str) -> list[tuple[str, int]]:
    """The texts and labels that training takes, on the driver: bounded by the parameters above.
    Rows with a NULL key or label, and held-out rows, are none."""
    marked = pick(labels, _k=key, _y=label).filter((_third(F.col("_k")) != 1) & F.col("_y").isin(0, 1)).distinct()
    some = [marked.filter(F.col("_y") == y).orderBy(F.xxhash64("_k"), "_k").limit(n) for y, n in ((1, TRAIN_TOXIC), (0, TRAIN_CLEAN))]
    body = pick(docs, _key=key, _text=text).withColumn("_text", whole_text("_text")).filter(F.length("_text") <= TRAIN_CHARS)
    # the label rows are bounded by the limits
    found = body.join(F.broadcast(some[0].unionByName(some[1])), F.col("_key") == F.col("_k"))
    found = found.orderBy(F.xxhash64("_k"), "_k", "_y", "_text").limit(TRAIN_TOXIC + TRAIN_CLEAN)
    return [(x["_text"], int(x["_y"])) for x in found.select("_text", "_y").collect()]


def toxicity(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """One row per row of ``docs``: ``key``, ``held_out`` (the row's label is not learnt from),
    ``score`` from 0 to 1, higher where the label 1 is likelier, and ``predicted``, 1 from
    TOXIC_FROM on.

    The score depends on the whole text alone. NULL and empty texts are one window without
    words and get its score. Without labels of both kinds nothing can be learnt and every
    score is 0. Repeated rows come back as often as given, NULL keys are not held out, an empty
    table gives an empty result."""
    rows = training_rows(docs, labels, key, text, label)
    fitted = docs.sparkSession.sparkContext.broadcast(train([t for t, _ in rows], [y for _, y in rows]))
    number = id(fitted)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = fitted.value
        store = worker_store()
        if q is not None and store.get("toxicity", (None,))[0] != number:
            store["toxicity"] = number, Scorer(q)
        for batch in batches:
            for start, texts in portions(batch, 1, AT_ONCE):
                scores = store["toxicity"][1].scores(texts) if q is not None else np.zeros(len(texts))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(texts)), pa.array(scores, pa.float64())],
                                                 names=["_key", "score"])

    base = pick(docs, _key=key, _text=text).withColumn("_text", whole_text("_text"))
    out = base.mapInArrow(score, f"_key {base.schema['_key'].dataType.simpleString()}, score double")
    return out.select(F.col("_key").alias(key), (_third(F.col("_key")) == 1).alias("held_out"), "score",
                      (F.col("score") >= TOXIC_FROM).cast("int").alias("predicted"))


by_value(__name__)
