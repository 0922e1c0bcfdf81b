"""Source divergence audit: how far the sources of a language differ in their words.

Terms in at least LEAST_DOCS documents of a language are kept. A group (language and source)
gives term t the share p = 1 + floor(SCALE (count + 2) / (N + 2 V)), N its occurrences of kept
terms, V their number; two shares differ by floor((p - q)^2 / (p + q)). For every pair of
sources the differences are summed over all kept terms, for every group its own terms are
compared with the language's. All numbers are exact.

Summing over all terms for all pairs would take terms x sources^2 steps. A term's row lists
the sources that have it with their counts; most pairs of a row are zero. With z a source's
share of a term that it lacks,

    f(p, q) = f(z, z') + [f(p, z') - f(z, z')] + [f(z, q) - f(z, z')] + c(p, q)
    c(p, q) = f(p, q) - f(p, z') - f(z, q) + f(z, z')

the first sum is V f(z, z'), the second and third go over a source's own counts, and only c
over the pairs of a row. Rows are inserted into a frequent-pattern tree in the order of the
sources: equal beginnings share a path, whose nodes count the rows that pass them, and c is
taken once for each node and each of its ancestors, times the node's count. Rows are dealt out
by ranges of their own order and sorted, so that a task's rows are a few whole subtrees, of which it
holds a block of rows at a time. A path cut by a border is counted in parts, whose sums add up.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tableops.llm.common import by_value, checked_broadcast, pick, whole_text, written

SCALE, LEAST_DOCS, TOP_TERMS = 1_000_000_000, 10, 10
#: Distinct terms that a Python worker counts before it passes them on.
HELD_TERMS = 400_000
#: Items of rows (padded to equal length) that a Python worker makes a tree of at once.
HELD_ITEMS = 400_000
#: Bytes to term bytes: A-Z lower-cased, every other ASCII byte that is no letter a space.
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


def terms_of(text: bytes) -> list[bytes]:
    """Runs of ASCII letters and non-ASCII characters, only A-Z lower-cased."""
    return text.translate(TERM_BYTES).split()


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, UTF-8 text) to partial (lang, source, term, n, docs)."""
    counts: dict[tuple[str, str], tuple[Counter, Counter]] = defaultdict(lambda: (Counter(), Counter()))

    def flushed() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in counts.items():
            terms = list(n)
            yield pa.RecordBatch.from_arrays(
                [pa.repeat(lang, len(terms)), pa.repeat(source, len(terms)), pa.array(terms, pa.binary()).cast(pa.string()),
                 pa.array(list(n.values()), pa.int64()), pa.array([docs[t] for t in terms], pa.int64())],
                names=["lang", "source", "term", "n", "docs"])
        counts.clear()

    held = 0
    for batch in batches:
        for lang, source, text in zip(*[batch.column(k) for k in range(3)]):
            n, docs = counts[lang.as_py(), source.as_py()]
            terms = terms_of(text.as_py())
            before = len(n)
            n.update(terms)
            docs.update(set(terms))
            held += len(n) - before
            if held >= HELD_TERMS:
                yield from flushed()
                held = 0
    yield from flushed()


def _share(count: Column | int, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE (count + 2) / (total + 2 terms)) in exact decimals."""
    count = (F.lit(count) if isinstance(count, int) else count).cast("decimal(19,0)")
    above = F.lit(SCALE).cast("decimal(10,0)") * (count + F.lit(2).cast("decimal(1,0)"))
    return F.call_function("div", above.cast("decimal(31,0)"), (total + 2 * terms).cast("decimal(31,0)")) + F.lit(1)


def _difference(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def _apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = p - q
    return d * d // (p + q)


def _padded(flat: np.ndarray, inside: np.ndarray) -> np.ndarray:
    out = np.zeros(inside.shape, dtype=np.int64)
    out[inside] = flat
    return out


def _path_sums(items: np.ndarray, size: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pair corrections of the tree of a language's sorted rows, added up by pair: sources, later
    sources, values. ``items`` holds (source, count, share, share of a missing term) of all
    rows in turn, ``size`` items a row; ``many`` terms have that row.

    The tree is made level by level: its nodes at a depth are the stretches of rows that
    agree up to there."""
    inside = np.arange(size.max()) < size[:, None]
    s, n, p, z = (_padded(c, inside) for c in items)
    other = (s[1:] != s[:-1]) | (n[1:] != n[:-1]) | ~inside[1:] | ~inside[:-1]
    shared = np.concatenate([[0], np.where(other.any(axis=1), other.argmax(axis=1), inside.shape[1])])
    base = int(s.max()) + 1
    pairs, values = [], []
    for depth in range(1, inside.shape[1]):
        first = np.flatnonzero(shared <= depth)
        passed = np.add.reduceat(many, first)
        node = inside[first, depth]
        first, passed = first[node], passed[node, None]
        own, q, y = (x[first, depth][:, None] for x in (s, p, z))
        above, p_above, z_above = (x[first, :depth] for x in (s, p, z))
        values.append((passed * (_apart(p_above, q) - _apart(p_above, y) - _apart(z_above, q) + _apart(z_above, y))).ravel())
        pairs.append((above * base + own).ravel())
    pairs, values = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (pairs, values))
    met, at = np.unique(pairs, return_inverse=True)
    total = np.zeros(len(met), dtype=np.int64)
    np.add.at(total, at, values)
    return met // base, met % base, total


def _corrected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (lang, items of (source, count, share, share of a missing term), terms)
    to partial sums (lang, source, later source, value) of pair corrections."""
    for batch in batches:
        langs = batch.column(0).to_numpy(zero_copy_only=False)
        rows, many = batch.column(1), batch.column(2).to_numpy(zero_copy_only=False)
        size = rows.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        items = np.stack([c.to_numpy(zero_copy_only=False) for c in rows.flatten().flatten()])
        end = np.cumsum(size)
        borders = {0, len(langs), *(np.flatnonzero(langs[1:] != langs[:-1]) + 1).tolist(),
                   *range(0, len(langs), max(1, HELD_ITEMS // int(size.max(initial=1))))}
        for a, b in pairwise(sorted(borders)):
            one, two, value = _path_sums(items[:, end[a] - size[a]:end[b - 1]], size[a:b], many[a:b])
            yield pa.RecordBatch.from_arrays([pa.repeat(langs[a], len(one)), pa.array(one), pa.array(two), pa.array(value)],
                                             names=["lang", "s", "t", "v"])


def source_divergence(df: DataFrame, text: str = "text", lang: str = "lang", source: str = "source",
                      least_docs: int = LEAST_DOCS, top_terms: int = TOP_TERMS) -> DataFrame:
    """``lang``, ``source``, ``part``, ``item``, ``value`` and ``rank``. Part ``pair``: every
    other source of the language with the difference summed over all kept terms. Part
    ``term``: of the kept terms that the group has and uses more than its language does, the
    ``top_terms`` that differ most. Ranks count from 1 by falling value, equals by item.

    NULL text, language and source count as empty strings. A group without terms takes part;
    without kept terms all pairs are 0 and no term is listed. Rows are documents: repeated ones
    count each. A language of one source has no pair. An empty table gives an empty result."""
    base = pick(df, _text=text, lang=lang, source=source).select(
        *[whole_text(c).alias(c) for c in ("lang", "source")], F.encode(whole_text("_text"), "UTF-8").alias("_text"))
    counts = base.mapInArrow(_counted, "lang string, source string, term string, n long, docs long") \
        .groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    counts = written(counts)
    kept = counts.groupBy("lang", "term").agg(F.sum("n").alias("all"), F.sum("docs").alias("docs")) \
        .filter(F.col("docs") >= least_docs).select(F.col("lang").alias("_l"), F.col("term").alias("_t"), "all")
    own = written(counts.join(written(kept), (F.col("lang") == F.col("_l")) & (F.col("term") == F.col("_t")))
                      .select("lang", "source", "term", "n", "all"))
    # groups: their number within the language, N, V and the share of a term that they lack
    langs = own.groupBy("lang", "term").agg(F.first("all").alias("n")).groupBy(F.col("lang").alias("_l")) \
        .agg(F.count(F.lit(1)).alias("terms"), F.sum("n").alias("total_lang"))
    sums = own.groupBy(F.col("lang").alias("_gl"), F.col("source").alias("_gs")).agg(F.sum("n").alias("total"))
    groups = base.select("lang", "source").distinct() \
        .join(sums, (F.col("lang") == F.col("_gl")) & (F.col("source") == F.col("_gs")), "left") \
        .join(langs, F.col("lang") == F.col("_l"), "left") \
        .select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("terms", F.lit(0)).alias("terms"),
                F.coalesce("total_lang", F.lit(0)).alias("total_lang"))
    groups = groups.withColumn("s", F.row_number().over(Window.partitionBy("lang").orderBy("source")).cast("long")) \
        .withColumn("z", F.when(F.col("terms") > 0, _share(0, F.col("total"), F.col("terms"))))
    groups = written(groups)

    known = checked_broadcast(groups.select(F.col("lang").alias("_l"), F.col("source").alias("_s"), "s", "z", "total", "terms", "total_lang"))
    shares = own.join(known, (F.col("lang") == F.col("_l")) & (F.col("source") == F.col("_s"))).withColumns({
        "p": _share(F.col("n"), F.col("total"), F.col("terms")), "q": _share(F.col("all"), F.col("total_lang"), F.col("terms"))})
    more = shares.filter("p > q").select("lang", "source", F.col("term").alias("item"), _difference(F.col("p"), F.col("q")).alias("value"))
    falling = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = more.withColumn("rank", F.row_number().over(falling)).filter(F.col("rank") <= top_terms) \
        .select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")

    # rows of the tree; equal ones are one, with the number of their terms
    rows = shares.groupBy("lang", "term").agg(F.sort_array(F.collect_list(F.struct("s", "n", "p", "z"))).alias("row")) \
        .groupBy("lang", "row").agg(F.count(F.lit(1)).alias("m"))
    rows = written(rows)
    paths = rows.repartitionByRange("lang", "row").sortWithinPartitions("lang", "row")
    corrections = paths.mapInArrow(_corrected, "lang string, s long, t long, v long")
    single = rows.select("lang", "m", F.explode("row").alias("x")).groupBy("lang", "x.s", "x.p", "x.z").agg(F.sum("m").alias("m"))
    other = checked_broadcast(groups.select(F.col("lang").alias("_l"), F.col("s").alias("t"), F.col("z").alias("y"), "terms"))
    zeros = _difference(F.col("z"), F.col("y"))
    singles = single.join(other, (F.col("lang") == F.col("_l")) & (F.col("s") != F.col("t"))) \
        .select("lang", "s", "t", (F.col("m") * (_difference(F.col("p"), F.col("y")) - zeros)).alias("v"))
    base_sums = groups.select("lang", "s", "z").join(other, (F.col("lang") == F.col("_l")) & (F.col("s") < F.col("t"))) \
        .select("lang", "s", "t", F.coalesce(F.col("terms") * zeros, F.lit(0)).alias("v"))
    parts = base_sums.unionByName(singles.select("lang", F.least("s", "t").alias("s"), F.greatest("s", "t").alias("t"), "v")) \
        .unionByName(corrections)
    sums = written(parts.groupBy("lang", "s", "t").agg(F.sum("v").alias("value")))
    both = sums.unionByName(sums.select("lang", F.col("t").alias("s"), F.col("s").alias("t"), "value"))
    names = checked_broadcast(groups.select(F.col("lang").alias("_l"), F.col("s").alias("_n"), "source"))
    mine = names.select(F.col("_l").alias("_ml"), F.col("_n").alias("_mn"), "source")
    items = names.select("_l", "_n", F.col("source").alias("item"))
    pairs = both.join(mine, (F.col("lang") == F.col("_ml")) & (F.col("s") == F.col("_mn"))) \
        .join(items, (F.col("lang") == F.col("_l")) & (F.col("t") == F.col("_n"))) \
        .select("lang", "source", F.lit("pair").alias("part"), "item", "value") \
        .withColumn("rank", F.row_number().over(falling))
    return pairs.unionByName(terms)


by_value(__name__)
