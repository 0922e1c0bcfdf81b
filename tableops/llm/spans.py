"""Substring dedup by sliding sentence spans.

A text is cut into sentences (after ``.``, ``!`` or ``?`` before white space, and at line
ends; sentences of more than LONG words are cut again where a hash of two words is the least in
a window of LONG words, so that equal passages are cut alike wherever they stand, and no piece
is longer). At every sentence begins and ends a run of consecutive sentences that is the
shortest with at least LEAST_SENTENCES sentences and LEAST_WORDS words; any longer run that is
repeated is covered by the shortest ones inside it, its head by those that begin there and its
tail by those that end there. All these runs are hashed to 96 bits, in lower case and with single
spaces, and met globally: of each hash the number and the first place, by document key, text
and sentence, are combined before the shuffle, so that a passage shared by a third of all
documents is a few rows a task. Places of repeated runs then meet the run's first place; all
sentences inside a run that is not the first go. Hot runs are split by Spark's skew handling,
the other side of the join has one row a run.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import pairwise
from zlib import crc32

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableops.llm.common import by_value, pick, portions, whole_text, written

LEAST_SENTENCES, LEAST_WORDS = 2, 20
#: A passage loses at most LONG words before its first cut that all its copies share and LONG + 1
#: after the last, so that 51 words leave 20, in two pieces at least.
LONG = 15
AT_ONCE = 4_000_000
BORDER = re.compile(r"(?:[.!?]+(?=\s)|\n)\s*")
WORD = re.compile(r"\S+\s*")


def _whole_sentences(text: str) -> list[str]:
    """The text cut at sentence borders only; leading white space is no sentence."""
    out, at = [], 0
    for m in BORDER.finditer(text):
        if at or not text[:m.end()].isspace():
            out.append(text[at:m.end()])
            at = m.end()
    if at < len(text):
        out.append(text[at:])
    return out


def _cuts(words: list[str]) -> list[int]:
    """Where a sentence of more than LONG words (in lower case) is cut: at the last least hash
    of two words in every window of LONG words."""
    h = [crc32(f"{a} {b}".encode("utf-8", "surrogatepass")) for a, b in pairwise(words)]
    h.append(crc32(words[-1].encode("utf-8", "surrogatepass")))
    out, at = [], -1
    for end in range(LONG, len(h) + 1):
        if at < end - LONG:
            window = h[end - LONG:end]
            at = end - 1 - window[::-1].index(min(window))
        elif h[end - 1] <= h[at]:
            at = end - 1
        else:
            continue
        if at:
            out.append(at)
    return out


def sentences(text: str) -> list[str]:
    """The text in pieces that joined give it back."""
    out = []
    for s in _whole_sentences(text):
        if len(s) < 2 * LONG or len(words := WORD.findall(s)) <= LONG:
            out.append(s)
            continue
        lead = s[:len(s) - sum(map(len, words))]
        parts = ["".join(words[i:j]) for i, j in pairwise([0, *_cuts(s.lower().split()), len(words)])]
        out += [lead + parts[0], *parts[1:]]
    return out


def _sentence_words(text: str) -> list[list[str]]:
    """The words of each of the ``sentences``, in lower case."""
    out = []
    for s in _whole_sentences(text):
        words = s.lower().split()
        if len(words) <= LONG:
            out.append(words)
        else:
            out += [words[i:j] for i, j in pairwise([0, *_cuts(words), len(words)])]
    return out


def runs(text: str) -> list[tuple[int, int, int, int]]:
    """The shortest run that begins at each sentence and the shortest that ends at each, none
    twice: first sentence, 64 and 32 bits of the run's hash and its number of sentences."""
    plain = [(" ".join(w), len(w)) for w in _sentence_words(text)]
    found = set()
    end, words = 0, 0
    for start, (_, n) in enumerate(plain):
        while end < len(plain) and (words < LEAST_WORDS or end - start < LEAST_SENTENCES):
            words += plain[end][1]
            end += 1
        if words < LEAST_WORDS or end - start < LEAST_SENTENCES:
            break
        found.add((start, end))
        words -= n
    start, words = 0, 0
    for end, (_, n) in enumerate(plain, 1):
        words += n
        while end - start > LEAST_SENTENCES and words - plain[start][1] >= LEAST_WORDS:
            words -= plain[start][1]
            start += 1
        if words >= LEAST_WORDS and end - start >= LEAST_SENTENCES:
            found.add((start, end))
    out = []
    for start, end in sorted(found):
        h = xxhash.xxh3_128_intdigest(" ".join([p for p, _ in plain[start:end]]).encode("utf-8", "surrogatepass"))
        out.append((start, (h >> 64) - (1 << 63), (h & (1 << 32) - 1) - (1 << 31), end - start))
    return out


RUN = "struct<_at:int,hi:bigint,lo:int,len:int>"
_RUN_TYPE = pa.struct([("_at", pa.int32()), ("hi", pa.int64()), ("lo", pa.int32()), ("len", pa.int32())])


def _run_rows(df: DataFrame, key: str, text: str) -> DataFrame:
    """A row for each run: its document (``_key``, and ``_t``, a hash of the text that tells
    documents of one key apart), first sentence, hash and length."""
    body = whole_text("_text")
    base = pick(df, _key=key, _text=text).select(
        F.struct(F.col("_key").alias("_key"), F.xxhash64(body).alias("_t")).alias("_doc"), body.alias("_text"))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [f.type for f in _RUN_TYPE]
        for batch in batches:
            for start, texts in portions(batch, 1, AT_ONCE):
                offsets, columns = [0], [[] for _ in types]
                for t in texts:
                    for run in runs(t):
                        for column, value in zip(columns, run):
                            column.append(value)
                    offsets.append(len(columns[0]))
                flat = pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], fields=list(_RUN_TYPE))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(start, len(texts)), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat)],
                    names=["_doc", "_runs"])

    out = base.mapInArrow(found, f"_doc {base.schema['_doc'].dataType.simpleString()}, _runs array<{RUN}>")
    return out.select("_doc.*", F.explode("_runs").alias("_run")).select("_key", "_t", "_run.*")


def _repeats(df: DataFrame, key: str, text: str) -> DataFrame:
    """(``_key``, ``_t``, ``removed``, ``first``): for each document that loses sentences their
    numbers, and the keys of the documents that had them first."""
    rows = _run_rows(df, key, text).select("hi", "lo", "len", F.struct("_key", "_t", "_at").alias("_place"))
    first = rows.groupBy(F.col("hi").alias("_h"), F.col("lo").alias("_l")).agg(
        F.min("_place").alias("_first"), F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n")
    # written first, so that the join deals out both sides itself and can split hot runs
    later = rows.join(written(first), (F.col("hi") == F.col("_h")) & (F.col("lo") == F.col("_l"))) \
        .filter(~F.col("_place").eqNullSafe(F.col("_first")))
    covered = F.sequence(F.col("_place._at"), F.col("_place._at") + F.col("len") - 1)
    return later.select("_place.*", covered.alias("_cover"), F.col("_first._key").alias("_from")) \
        .groupBy("_key", "_t").agg(
            F.sort_array(F.array_distinct(F.flatten(F.collect_list("_cover")))).alias("removed"),
            F.sort_array(F.collect_set("_from")).alias("first"))


def repeated_spans(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per distinct row of ``df`` that loses sentences: ``key``, ``n_removed``,
    ``removed`` (numbers of the sentences from 0, ascending) and ``first_keys`` (the documents
    in which the removed runs occur first).

    NULL text counts as empty; a text without two sentences of twenty words together has no
    run and loses nothing. The first of equal runs is that of the least key (NULL before
    all), then text, then sentence. Rows equal in key and text are one document given
    several times. Documents that lose nothing, and empty tables, give no row."""
    return _repeats(df, key, text).select(F.col("_key").alias(key), F.size("removed").alias("n_removed"), "removed",
                                          F.col("first").alias("first_keys"))


def drop_repeated_spans(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``df`` with the same rows and columns; ``text`` without the sentences that
    ``repeated_spans`` names. A text that loses nothing stays as it is."""
    rows = df.select(F.struct(*[df[c] for c in df.columns]).alias("_row"), df[text].alias("_text"),
                     df[key].alias("_k"), F.xxhash64(whole_text(df[text])).alias("_h"))
    rows = rows.join(_repeats(df, key, text), (F.col("_h") == F.col("_t")) & F.col("_k").eqNullSafe(F.col("_key")), "left").select("_row", "_text", "removed")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for value, gone in zip(batch.column(1), batch.column(2)):
                t, gone = value.as_py(), gone.as_py()
                if gone:
                    drop = set(gone)
                    t = "".join([s for k, s in enumerate(sentences(t)) if k not in drop])
                out.append(t)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["_row", "_text"])

    out = rows.mapInArrow(cut, f"_row {rows.schema['_row'].dataType.simpleString()}, _text string")
    return out.select(*[F.col("_text").alias(c) if c == text else F.col("_row")[c].alias(c) for c in df.columns])


by_value(__name__)
