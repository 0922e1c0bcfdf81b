"""MinHash near-deduplication with ProbMinHash.

A text is the bag of its runs of five words; a run's count is its weight. For each run a
Poisson process with that weight as rate strikes random registers; a register keeps the run
that struck it first. Runs stop as soon as their next arrival comes after the latest first
strike of all registers, so that a text costs about its length plus m log m arrivals. Two
texts agree in a register with a probability equal to their probability Jaccard similarity.

Registers are banded; texts that agree in a band share a bucket, and ``links.linked`` joins
a bucket's similar texts without listing its pairs. Similarity is verified exactly on the
bags. Equal texts are one node from the start, combined before the shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableops.llm.common import by_value, checked_broadcast, keys, meet_first, meet_left, pick, portions, removed, thin, whole_text, wide_key, work_folder, written
from tableops.llm.links import linked, shared_buckets

WORDS = 5
SIMILAR = 0.8
#: 25 bands of 5: a pair at 0.8 shares no bucket with probability 0.00005. Beyond the stars, it is
#: compared if 183 of 256 sketch registers agree, and missed with another 0.00005; an unlike pair
#: at 0.57 passes with 0.0001.
REGISTERS, ROWS, BANDS = 256, 5, 25
SKETCH_LONGS, AGREE = REGISTERS // 16, 183
#: Texts that many others meet in one bucket get a wider sketch, as many unlike ones at 0.67 pass
#: the first: a pair at 0.8 agrees in fewer than 782 of 1,024 with a probability of 0.00003.
WIDE, WIDE_AGREE = 1024, 782
#: Bags whose wide registers are made at once.
BAGS_AT_ONCE = 256
#: Characters that a Python worker takes up at once.
AT_ONCE = 1_200_000
KEPT_WORDS = 500_000


def _mixed(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit multiplicative hash."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _WordHashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= KEPT_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


def shingle_bags(texts: list[str], memory: _WordHashes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per distinct run of a text: the text's number, the run's hash, its count; by text,
    then hash. A text of fewer than five words is one run, a blank text the empty run."""
    words = [t.lower().split() for t in texts]
    n = np.array([len(w) for w in words], dtype=np.int64)
    flat = np.fromiter((memory[x] for w in words for x in w), dtype=np.uint64, count=int(n.sum()))
    ends = np.cumsum(n)
    run, doc = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if len(flat) >= WORDS:
        run = flat[:len(flat) - WORDS + 1].copy()
        for k in range(1, WORDS):
            run = _mixed(run) + flat[k:len(flat) - WORDS + 1 + k]
        place = np.arange(len(run))
        doc = np.searchsorted(ends, place, side="right")
        inside = place + WORDS <= ends[doc]
        run, doc = run[inside], doc[inside]
    short = np.flatnonzero(n < WORDS)
    whole = [xxhash.xxh64_intdigest(" ".join(words[k]).encode("utf-8", "surrogatepass")) for k in short]
    run = _mixed(np.concatenate([run, np.array(whole, dtype=np.uint64)]))
    doc = np.concatenate([doc, short])
    order = np.lexsort((run, doc))
    run, doc = run[order], doc[order]
    first = np.ones(len(run), dtype=bool)
    first[1:] = (run[1:] != run[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(first)
    return doc[at], run[at], np.diff(np.append(at, len(run)))


def prob_min_hash(doc: np.ndarray, run: np.ndarray, weight: np.ndarray, n: int, m: int = REGISTERS) -> np.ndarray:
    """``n`` x ``m`` registers, each the hash of the run that struck it first. All runs take
    one arrival a turn, those too late for every register of their text drop out."""
    when = np.full(n * m, np.inf)
    who = np.zeros(n * m, dtype=np.uint64)
    time = np.zeros(len(run))
    alive = np.arange(len(run))
    turn = 0
    while alive.size:
        turn += 1
        dice = _mixed(run[alive] + np.uint64(turn * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        time[alive] -= np.log(((dice >> np.uint64(11)).astype(float) + 0.5) * 2.0 ** -53) / weight[alive]
        early = time[alive] < when.reshape(n, m).max(axis=1)[doc[alive]]
        alive, dice = alive[early], dice[early]
        struck = doc[alive] * m + (_mixed(dice ^ np.uint64(0xD1B54A32D192ED03)) % np.uint64(m)).astype(np.int64)
        t = time[alive]
        np.minimum.at(when, struck, t)
        won = when[struck] == t
        who[struck[won]] = run[alive[won]]
    return who.reshape(n, m)


def prob_jaccard(a: np.ndarray, wa: np.ndarray, b: np.ndarray, wb: np.ndarray) -> float:
    """Exact probability Jaccard similarity of two weighted sets (hashes sorted): the sum over
    common d of 1 / sum over d' of max(wa[d'] / wa[d], wb[d'] / wb[d])."""
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    u, v = wa[i].astype(float), wb[j].astype(float)
    only_a, only_b = wa.sum() - u.sum(), wb.sum() - v.sum()
    order = np.argsort(u / v, kind="stable")
    u, v = u[order], v[order]
    # for runs of equal ratio it does not matter on which side of the maximum they count
    above = np.cumsum(u[::-1])[::-1]
    below = np.cumsum(v) - v
    return float(np.sum(1.0 / ((only_a + above) / u + (only_b + below) / v)))


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(hi, lo, text) to (hi, lo, bands, sketch): a hash of each band of registers, and four
    bits of every register."""
    memory = _WordHashes()
    for batch in batches:
        for start, texts in portions(batch, 2, AT_ONCE):
            doc, run, count = shingle_bags(texts, memory)
            who = prob_min_hash(doc, run, count, len(texts))
            bands = []
            for b in range(BANDS):
                h = np.full(len(texts), b, dtype=np.uint64)
                for k in range(ROWS):
                    h = _mixed(h) + who[:, b * ROWS + k]
                bands.append(_mixed(h))
            keys = batch.slice(start, len(texts))
            yield pa.RecordBatch.from_arrays([keys.column(0), keys.column(1), _rows(bands), _rows(_nibbles(who))],
                                             names=["hi", "lo", "bands", "sketch"])


def _nibbles(who: np.ndarray) -> list[np.ndarray]:
    """Four bits of every register, sixteen to a number."""
    low = _mixed(who) & np.uint64(15)
    return [np.bitwise_or.reduce(low[:, 16 * k:16 * k + 16] << (np.arange(16, dtype=np.uint64) * np.uint64(4)), axis=1)
            for k in range(who.shape[1] // 16)]


def _rows(columns: list[np.ndarray]) -> pa.ListArray:
    """A list column whose lists are the rows of the columns."""
    flat = np.stack(columns, axis=1).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(np.arange(0, flat.size + 1, flat.shape[1], dtype=np.int32)), pa.array(flat.ravel()))


def _bagged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(hi, lo, text) to (hi, lo, runs, counts)."""
    memory = _WordHashes()
    for batch in batches:
        for start, texts in portions(batch, 2, AT_ONCE):
            doc, run, count = shingle_bags(texts, memory)
            offsets = pa.array(np.searchsorted(doc, np.arange(len(texts) + 1)).astype(np.int32))
            keys = batch.slice(start, len(texts))
            yield pa.RecordBatch.from_arrays(
                [keys.column(0), keys.column(1), pa.ListArray.from_arrays(offsets, pa.array(run.view(np.int64))),
                 pa.ListArray.from_arrays(offsets, pa.array(count.astype(np.int32)))], names=["hi", "lo", "runs", "counts"])


def _widened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, runs, counts) to (node, wide)."""
    for batch in batches:
        for start in range(0, batch.num_rows, BAGS_AT_ONCE):
            node, runs, counts = batch.slice(start, BAGS_AT_ONCE).columns
            doc = np.repeat(np.arange(len(runs)), runs.value_lengths().to_numpy())
            run = runs.flatten().to_numpy().view(np.uint64)
            who = prob_min_hash(doc, run, counts.flatten().to_numpy(), len(runs), WIDE)
            yield pa.RecordBatch.from_arrays([node, _rows(_nibbles(who))], names=["node", "wide"])


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs with both bags to the similar pairs."""
    for batch in batches:
        cols = [batch.column(k) for k in range(2, 6)]
        keep = []
        for k in range(batch.num_rows):
            a, wa, b, wb = (c[k].values.to_numpy(zero_copy_only=False) for c in cols)
            keep.append(prob_jaccard(a.view(np.uint64), wa, b.view(np.uint64), wb) >= SIMILAR)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))


NODE = "struct<hi:bigint,lo:bigint>"


def near_classes(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per distinct text: ``hi``, ``lo`` (``wide_key`` of the text), ``class_hi``,
    ``class_lo`` (the class), ``class_id`` (the least key of the class), ``class_size``."""
    folder = work_folder(df.sparkSession)
    base = pick(df, _key=key, _text=text).withColumn("_text", whole_text("_text"))
    hi, lo = wide_key(F.col("_text"))
    keyed = base.select(hi.alias("hi"), lo.alias("lo"), "_text", "_key")
    signed = keyed.select("hi", "lo", "_text").mapInArrow(_signed, "hi long, lo long, bands array<long>, sketch array<long>")
    signed = written(signed.groupBy("hi", "lo").agg(F.first("bands").alias("bands"), F.first("sketch").alias("sketch")), folder)
    shared = written(shared_buckets(signed.select(F.explode("bands").alias("bucket"), "hi", "lo"), folder), folder)
    wanted = keys(shared.select(F.col("node.hi").alias("_hi"), F.col("node.lo").alias("_lo")).distinct(), ["_hi", "_lo"], folder)
    texts = meet_first(keyed.select("hi", "lo", "_text"), ["hi", "lo"], wanted, "_text")
    bags = written(texts.mapInArrow(_bagged, "hi long, lo long, runs array<long>, counts array<int>")
                   .select(F.struct("hi", "lo").alias("_node"), "runs", "counts"), folder)

    def similar(pairs: DataFrame) -> DataFrame:
        left = bags.select(F.col("_node").alias("_a"), F.col("runs").alias("_ra"), F.col("counts").alias("_ca"))
        both = pairs.join(left, F.col("a") == F.col("_a")).join(bags, F.col("b") == F.col("_node"))
        return both.select("a", "b", "_ra", "_ca", "runs", "counts").mapInArrow(_verified, f"a {NODE}, b {NODE}")

    def wider(nodes: DataFrame) -> DataFrame:
        few = checked_broadcast(nodes, folder)
        return bags.join(few, F.col("_node") == F.col("node"), "left_semi").mapInArrow(_widened, f"node {NODE}, wide array<long>")

    own = thin(signed, ["hi", "lo"], wanted).select(F.struct("hi", "lo").alias("node"), "bands", "sketch")
    root = linked(shared, similar, own, SKETCH_LONGS, AGREE, folder,
                  wider=wider, wide_longs=WIDE // 16, wide_least=WIDE_AGREE)
    nodes = keyed.groupBy("hi", "lo").agg(F.min("_key").alias("_least"), F.count(F.lit(1)).alias("_n"))
    nodes = nodes.join(root.select(F.col("node.hi").alias("_h"), F.col("node.lo").alias("_l"), "root"),
                       (F.col("hi") == F.col("_h")) & (F.col("lo") == F.col("_l")), "left") \
        .select("hi", "lo", "_least", "_n", F.coalesce("root", F.struct("hi", "lo")).alias("_root"))
    nodes = written(nodes)
    removed(df.sparkSession, folder)
    classes = nodes.groupBy(F.col("_root").alias("_r")).agg(F.min("_least").alias("class_id"), F.sum("_n").alias("class_size"))
    return nodes.join(classes, F.col("_root") == F.col("_r")).select(
        "hi", "lo", F.col("_root.hi").alias("class_hi"), F.col("_root.lo").alias("class_lo"), "class_id", "class_size")


def near_dedup(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``df``: ``key``, ``class_id`` (the least key in the class of texts
    linked by a similarity of 0.8 or more) and ``class_size`` (its rows).

    NULL text counts as empty; all blank texts are alike. A text of fewer than five words is
    like another only if its words are the same. NULL keys take part and are least only if
    all are NULL; repeated rows come back as often as given; an empty table gives an empty
    result."""
    hi, lo = wide_key(whole_text("_text"))
    rows = pick(df, _key=key, _text=text).select("_key", hi.alias("_hi"), lo.alias("_lo"))
    classes = near_classes(df, key, text)
    return rows.join(classes, (F.col("_hi") == F.col("hi")) & (F.col("_lo") == F.col("lo"))).select(
        F.col("_key").alias(key), "class_id", "class_size")


def keep_one(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``df`` with one row of each class, one with the least key; columns as they were."""
    hi, lo = wide_key(whole_text(df[text]))
    rows = df.select(F.struct(*[df[c] for c in df.columns]).alias("_row"), df[key].alias("_key"),
                     hi.alias("_hi"), lo.alias("_lo"))
    # most texts are alone in their class and stay where they are
    least = near_classes(df, key, text).filter("class_size > 1").select(
        F.col("hi").alias("_h"), F.col("lo").alias("_l"), "class_hi", "class_lo", "class_id")
    rows = meet_left(rows, ["_hi", "_lo"], keys(least, ["_h", "_l"]))
    first = rows.filter(F.col("_h").isNotNull() & F.col("_key").eqNullSafe(F.col("class_id")))
    first = first.groupBy("class_hi", "class_lo").agg(F.first("_row").alias("_row"))
    return rows.filter(F.col("_h").isNull()).select("_row.*").unionByName(first.select("_row.*"))


by_value(__name__)
