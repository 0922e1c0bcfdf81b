"""Periodic run detection: online sparse diagonal dynamic programming over words.

A run is a stretch in which words ``period`` apart are identical, with no smaller period, at
least four periods and six words long, and not to be extended. Words go by one at a time.
The earlier occurrences of a word name the diagonals (lags) on which it matches: an active
lag's match length grows by one, a lag that does not match ends and, if it held for long
enough, emits its run at once.

The table of lags is kept sparse without losing a run. A lag of a run holds for three periods
or more, so that it need not begin at its first word: lags of 1 to 31 begin where the last
four words occurred before at that distance, lags of 32 to 255 with 32 words, and so on by
eights. Where the last words themselves repeat at an active lag of a quarter of their length,
no other lag begins: words that do so all through a run would give it that smaller period.
Else equal stretches stand a quarter of their length apart, so that each word meets a
bounded number of earlier occurrences a size, and the work is n log n for any text. A lag that
begins is followed back to the first word at which it holds.

Rows are independent: there is no shuffle.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableops.llm.common import by_value, pick, portions, whole_text

LEAST_WORDS, LEAST_PERIODS = 6, 4
#: Words of the smallest stretch looked up, and the ratio of sizes.
STRETCH, TIMES = 4, 8
#: Bytes of text that a Python worker takes up at once.
AT_ONCE = 1_500_000


def _mixed(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit multiplicative hash."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _earlier(stretch: np.ndarray, inside: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """For each place the last earlier one of the same text whose stretch is equal, or -1;
    ``inside`` tells where a stretch lies in one text, ``begin`` where a place's text begins."""
    at = np.flatnonzero(inside)
    order = at[np.argsort(stretch[at], kind="stable")]
    same = stretch[order[1:]] == stretch[order[:-1]]
    out = np.full(len(stretch), -1, dtype=np.int64)
    out[order[1:][same]] = order[:-1][same]
    out[out < begin] = -1
    return out


def _levels(word: np.ndarray, begin: np.ndarray, longest: int) -> tuple[list[tuple], np.ndarray]:
    """Per size of stretch: its words, the least and the first too great lag, and the earlier
    occurrences of each place; and all places with one in reach."""
    place = np.arange(len(word))
    h, size = _mixed(word.astype(np.uint64) + np.uint64(1)), 1
    hit = np.zeros(len(word), dtype=bool)
    levels = []
    want = STRETCH
    while want == STRETCH or longest >= LEAST_PERIODS * want:
        while size < want:
            longer = np.zeros_like(h)
            longer[size:] = _mixed(h[:-size]) + h[size:]
            h, size = _mixed(longer), 2 * size
        prev = _earlier(h, place - begin >= size - 1, begin)
        hit |= (prev >= 0) & (place - prev < TIMES * size)
        levels.append((size, 1 if size == STRETCH else size, TIMES * size, prev.tolist()))
        want = TIMES * size
    return levels, np.flatnonzero(hit)


def _has_smaller(word: list[int], start: int, period: int) -> bool:
    """Whether the ``period`` words from ``start`` are a shorter stretch several times."""
    block = word[start:start + period]
    rest, f = period, 2
    while rest > 1:
        if f * f > rest:
            f = rest
        if rest % f == 0:
            d = period // f
            if block[d:] == block[:-d]:
                return True
            while rest % f == 0:
                rest //= f
        f += 1
    return False


def find_runs(word: list[int], sizes: list[int]) -> list[list[tuple[int, int, int]]]:
    """Per text the runs as (start, length, period), by start, then period; ``word`` holds the
    numbers of the words of all texts, ``sizes`` how many are each text's."""
    ends = np.cumsum(sizes)
    begins = (ends - sizes).tolist()
    flat = np.asarray(word, dtype=np.int64)
    levels, hits = _levels(flat, np.repeat(begins, sizes), max(sizes, default=0))
    out: list[list[tuple[int, int, int]]] = [[] for _ in sizes]
    active: dict[int, int] = {}
    first = text = 0
    greatest = 0

    def emit(lag: int, matches: int, end: int) -> None:
        if matches >= max((LEAST_PERIODS - 1) * lag, LEAST_WORDS - lag) and not _has_smaller(word, end - matches - lag, lag):
            out[text].append((end - matches - lag - first, matches + lag, lag))

    last = -2
    for i in hits.tolist():
        if i != last + 1:  # the word between has no earlier occurrence in reach
            for lag, matches in active.items():
                emit(lag, matches, last + 1)
            active.clear()
            text = bisect_right(begins, i) - 1
            while sizes[text] == 0:
                text -= 1
            first, greatest = begins[text], sizes[text] // LEAST_PERIODS
        ended = []
        for lag in active:
            if word[i] == word[i - lag]:
                active[lag] += 1
            else:
                ended.append(lag)
        for lag in ended:
            emit(lag, active.pop(lag), i)
        for size, least, beyond, earlier in levels:
            j = earlier[i]
            while j >= 0 and i - j < beyond:
                if any(4 * lag <= size <= matches + lag for lag, matches in active.items()):
                    break
                lag = i - j
                if least <= lag <= greatest and lag not in active:
                    matches = size
                    while i - matches - lag >= first and word[i - matches] == word[i - matches - lag]:
                        matches += 1
                    active[lag] = matches
                j = earlier[j]
        last = i
    for lag, matches in active.items():
        emit(lag, matches, last + 1)
    return [sorted(runs, key=lambda r: (r[0], r[2])) for runs in out]


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of the greatest exact length / period; of equals the first, then the shortest
    period."""
    best = None
    for run in runs:
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def kept_words(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run contains after its first ``period`` words."""
    if not runs:
        return words
    out, at = [], 0
    for start, end in sorted((s + p, s + n) for s, n, p in runs):
        if start > at:
            out += words[at:start]
        at = max(at, end)
    return out + words[at:]


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
RUN = "struct<start:bigint,length:bigint,period:bigint>"


def _detected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, UTF-8 text) to (key, number of words, runs, strongest run, kept words)."""
    for batch in batches:
        for start, texts in portions(batch, 1, AT_ONCE):
            words = [t.split() for t in texts]  # bytes are split at the six ASCII white spaces
            names: dict[bytes, int] = {}
            sizes = [len(w) for w in words]
            runs = find_runs([names.setdefault(x, len(names)) for w in words for x in w], sizes)
            rows = [[dict(zip(("start", "length", "period"), r)) for r in found] for found in runs]
            top = [(r := strongest(found)) and dict(zip(("start", "length", "period"), r)) for found in runs]
            kept = [b" ".join(kept_words(w, found)).decode("utf-8") for w, found in zip(words, runs)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(start, len(texts)), pa.array(sizes, pa.int64()), pa.array(rows, pa.list_(_RUN)),
                 pa.array(top, _RUN), pa.array(kept, pa.string())], names=["_key", "n_words", "runs", "strongest", "collapsed"])


def periodic_runs(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``df``: ``key``, ``n_words``, ``runs`` (``start`` in words from 0,
    ``length`` and ``period`` in words, by start, then period), ``strongest`` (the run of most
    periods, the first of equals; NULL without runs) and ``collapsed``, the words outside runs
    and of each run's first period, joined by single spaces.

    Words are what stands between ASCII white space, letters compared as they are. NULL, empty
    and blank texts have no words, no runs and an empty ``collapsed``. Rows are independent:
    repeated rows and NULL keys give a row each, an empty table none."""
    base = pick(df, _key=key, _text=text).select("_key", F.encode(whole_text("_text"), "UTF-8").alias("_text"))
    kind = base.schema["_key"].dataType.simpleString()
    out = base.mapInArrow(_detected, f"_key {kind}, n_words long, runs array<{RUN}>, strongest {RUN}, collapsed string")
    return out.withColumnRenamed("_key", key)


by_value(__name__)
