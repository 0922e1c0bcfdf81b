"""Benchmark decontamination [native]: SimHash of item-sized windows.

Words are runs of letters and digits in lower case; a text is the bag of its runs of five
words. A document is searched for windows as long as a benchmark item that are 0.8 or more
similar to it by weighted (bag) Jaccard similarity:

1. A similar window shares at least 4/9 of both bags' size with its item, and moving a
   window right to its first shared run loses none. So only windows that begin at a run of
   some item of their size, and that hold enough such runs, can be similar; all others are
   passed over without loss. What a document has in common with the benchmark is found by an
   equi-join of run hashes.
2. These windows and the items get 64-bit SimHash fingerprints. A fingerprint is cut into
   eight blocks; items are entered under every block value within two bits of their own, so
   that every pair within a distance of 23 shares an entry (eight blocks cannot all differ
   in three bits). Window size is part of the entry.
3. Candidates within that radius are verified by their exact similarity. Equal runs of a bag
   are numbered, so that a similarity of 0.8 bounds the share of votes that can differ. At 0.8 a
   pair's expected distance is 10 with a deviation of 3, so that the radius leaves out none but
   one in a million.

Every step is a built-in expression.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tableops.llm.common import checked_broadcast, let, pick, whole_text, wide_key
from tableops.plans.lineage import cut_lineage

WORDS = 5
SIMILAR = 0.8
BLOCKS, FLIPS = 8, 2
RADIUS = BLOCKS * (FLIPS + 1) - 1
#: Masks of eight bits that flip at most FLIPS of them.
MASKS = [m for m in range(256) if m.bit_count() <= FLIPS]


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _runs(words: Column, size: int) -> Column:
    """The hash of every run of ``size`` words, in order; the size is part of the hash."""
    def hashed(w: Column) -> Column:
        return F.when(F.size(w) < size, F.array().cast("array<bigint>")).otherwise(F.transform(
            F.sequence(F.lit(0), F.size(w) - size),
            lambda i: F.xxhash64(F.lit(size), *[F.get(w, i + k) for k in range(size)])))
    return let(words, hashed)


def _fingerprint(bag: Column) -> Column:
    """SimHash: a bit is set where more than half of the bag's hashes have it set."""
    bits = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda b: F.when(F.aggregate(
        bag, F.lit(0), lambda n, h: n + F.call_function("getbit", h, b).cast("int")) * 2 > F.size(bag),
        F.call_function("shiftleft", F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long")))
    return F.aggregate(bits, F.lit(0).cast("long"), lambda x, y: x.bitwiseOR(y))


def _block(fingerprint: Column, k) -> Column:
    return F.call_function("shiftright", fingerprint, F.lit(8) * k).bitwiseAND(F.lit(255)).cast("int")


def _numbered(bag: Column) -> Column:
    """The bag as a set: each hash mixed with how often it came before, so that bags have as many
    in common as these sets, and a repeated run has as many votes in a fingerprint."""
    def counted(b: Column) -> Column:
        return let(F.sort_array(b), lambda x: F.transform(x, lambda h, i: F.xxhash64(h, (i - F.array_position(x, h) + 1).cast("int"))))
    return let(bag, lambda b: F.when(F.size(F.array_distinct(b)) == F.size(b), F.transform(
        b, lambda h: F.xxhash64(h, F.lit(0)))).otherwise(counted(b)))


def benchmark_items(items: DataFrame, key: str, text: str) -> DataFrame:
    """Items of equal words once, with the least key: ``_item``, ``n`` (words), ``size`` (of a
    run: five, or all words of a shorter item) and ``bag``. Items without words are none."""
    words = pick(items, _key=key, _text=text).select("_key", _words(whole_text("_text")).alias("_w")).filter(F.size("_w") > 0)
    hi, lo = wide_key(F.array_join("_w", " "))
    one = words.groupBy(hi.alias("ihi"), lo.alias("ilo")).agg(F.min("_key").alias("_item"), F.first("_w").alias("_w"))
    n, size = F.size("_w"), F.least(F.size("_w"), F.lit(WORDS))
    bag = F.coalesce(*[F.when(size == s, _runs(F.col("_w"), s)) for s in range(1, WORDS + 1)])
    return one.select("ihi", "ilo", "_item", n.alias("n"), size.alias("size"), bag.alias("bag"))


def _windows(rows: DataFrame, items: DataFrame, sizes: list[int]) -> DataFrame:
    """(``thi``, ``tlo``, ``n``, ``size``, ``start``) of the windows that can be similar to an
    item of ``n`` words."""
    wanted = checked_broadcast(items.select("n", "size", F.explode("bag").alias("_h")).distinct())
    hits = None
    for s in sizes:  # five, and the sizes of shorter items
        runs = rows.select("thi", "tlo", _runs(F.col("_w"), s).alias("_r")) \
            .select("thi", "tlo", (F.size("_r") + s - 1).alias("words"), F.posexplode("_r").alias("at", "h"))
        found = runs.join(wanted, (F.col("h") == F.col("_h")) & (F.col("size") == s)).drop("_h", "h")
        hits = found if hits is None else hits.unionByName(found)
    places = hits.groupBy("thi", "tlo", "n", "size", "words").agg(F.sort_array(F.collect_set("at")).alias("_at"))
    last = F.greatest(F.lit(0), F.col("words") - F.col("n"))  # start of the last window
    holds = F.least("n", "words") - F.col("size") + 1  # runs of a window
    need = F.ceil((holds + F.col("n") - F.col("size") + 1) * (SIMILAR / (1 + SIMILAR)) - 1e-9).cast("int")
    places = places.withColumns({"_last": last, "_holds": holds, "_need": need})
    free = F.transform(F.col("_at"), lambda p, i: F.when(
        (p <= F.col("_last")) & (F.get("_at", i + F.col("_need") - 1) <= p + F.col("_holds") - 1), p))
    ends = F.when(F.size(F.filter("_at", lambda p: p >= F.col("_last"))) >= F.col("_need"), F.col("_last"))
    starts = F.array_distinct(F.filter(F.concat(free, F.array(ends)), lambda p: p.isNotNull()))
    return places.select("thi", "tlo", "n", "size", "_holds", F.explode(starts).alias("start"))


def contaminated(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text",
                 item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per distinct text and item found in it: ``thi``, ``tlo`` (``wide_key`` of the
    text), ``item``, ``similarity``, ``start`` (word) and ``distance`` of the best window."""
    known = cut_lineage(benchmark_items(items, item_key, item_text))
    sizes = sorted(r[0] for r in known.select("size").distinct().collect())  # five values at most
    body = whole_text("_text")
    thi, tlo = wide_key(body)
    rows = pick(docs, _key=key, _text=text).select(thi.alias("thi"), tlo.alias("tlo"), _words(body).alias("_w"), body.alias("_text"))
    if not sizes:
        return rows.select("thi", "tlo", F.lit(None).cast(known.schema["_item"].dataType).alias("item"),
                           F.lit(0.0).alias("similarity"), F.lit(0).alias("start"), F.lit(0).alias("distance")).filter(F.lit(False))
    windows = cut_lineage(_windows(rows, known, sizes))
    wanted = checked_broadcast(windows.select(F.col("thi").alias("_a"), F.col("tlo").alias("_b")).distinct())
    texts = rows.select("thi", "tlo", "_text").join(wanted, (F.col("thi") == F.col("_a")) & (F.col("tlo") == F.col("_b"))) \
        .groupBy(F.col("thi").alias("_a"), F.col("tlo").alias("_b")).agg(F.first("_text").alias("_text")) \
        .select("_a", "_b", _words(F.col("_text")).alias("_w"))
    texts = texts.select("_a", "_b", *[_runs(F.col("_w"), s).alias(f"_r{s}") for s in sizes])
    bag = F.coalesce(*[F.when(F.col("size") == s, F.slice(f"_r{s}", F.col("start") + 1, F.col("_holds"))) for s in sizes])
    windows = windows.join(texts, (F.col("thi") == F.col("_a")) & (F.col("tlo") == F.col("_b"))) \
        .select("thi", "tlo", "n", "start", _numbered(bag).alias("bag"))
    windows = cut_lineage(windows.withColumn("_f", let(F.col("bag"), _fingerprint)))
    known = cut_lineage(known.withColumn("bag", _numbered(F.col("bag"))).withColumn("_g", let(F.col("bag"), _fingerprint)))
    block = F.array(*[F.struct(F.lit(k).alias("k"), _block(F.col("_f"), k).alias("v")) for k in range(BLOCKS)])
    entered = windows.select("thi", "tlo", "n", "start", "_f", F.explode(block).alias("_e")) \
        .select("thi", "tlo", "n", "start", "_f", "_e.k", "_e.v")
    index = known.select("ihi", "ilo", F.col("n").alias("_n"), "_g", F.posexplode(F.array(*[
        _block(F.col("_g"), k) for k in range(BLOCKS)])).alias("_k", "_own"))
    index = index.select("ihi", "ilo", "_n", "_g", "_k", "_own", F.explode(F.array(*map(F.lit, MASKS))).alias("_mask")) \
        .withColumn("_v", F.col("_own").bitwiseXOR(F.col("_mask"))).drop("_own", "_mask")
    met = entered.join(index, (F.col("n") == F.col("_n")) & (F.col("k") == F.col("_k")) & (F.col("v") == F.col("_v")))
    differ = F.col("_f").bitwiseXOR(F.col("_g"))
    first = F.coalesce(*[F.when(F.bit_count(_block(differ, k)) <= FLIPS, F.lit(k)) for k in range(BLOCKS)])
    met = met.filter((F.bit_count(differ) <= RADIUS) & (F.col("k") == first)) \
        .select("thi", "tlo", "n", "start", "ihi", "ilo", F.bit_count(differ).alias("distance"))
    bags = known.select(F.col("ihi").alias("_ih"), F.col("ilo").alias("_il"), "_item", F.col("bag").alias("_bag"))
    own = windows.select(F.col("thi").alias("_a"), F.col("tlo").alias("_b"), F.col("n").alias("_n"),
                         F.col("start").alias("_s"), "bag")
    pairs = met.join(own, (F.col("thi") == F.col("_a")) & (F.col("tlo") == F.col("_b")) & (F.col("n") == F.col("_n"))
                     & (F.col("start") == F.col("_s"))) \
        .join(bags, (F.col("ihi") == F.col("_ih")) & (F.col("ilo") == F.col("_il")))
    c = F.col("_c")
    scored = pairs.withColumn("_c", F.size(F.array_intersect("bag", "_bag"))) \
        .withColumn("similarity", c / (F.size("bag") + F.size("_bag") - c)).filter(F.col("similarity") >= SIMILAR)
    best = F.max(F.struct("similarity", (-F.col("start")).alias("_s"), (-F.col("distance")).alias("_d")))
    return cut_lineage(scored.groupBy("thi", "tlo", "_item").agg(best.alias("_x")).select(
        "thi", "tlo", F.col("_item").alias("item"), "_x.similarity", (-F.col("_x._s")).alias("start"),
        (-F.col("_x._d")).alias("distance")))


def find_leaks(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text",
               item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per document and benchmark item found in it: ``key``, ``item_key`` (the least
    of the items with the same words), ``similarity``, ``start_word`` and ``distance`` (of
    fingerprints) of the most similar window, the first of equals.

    NULL and empty texts and items hold nothing. An item of fewer than five words is found
    where its words stand in a row. A document shorter than an item is compared as a whole.
    NULL document keys take part; repeated rows come back as often as given; an item whose
    key is NULL is reported under NULL. Without items or documents the result is empty."""
    thi, tlo = wide_key(whole_text("_text"))
    rows = pick(docs, _key=key, _text=text).select("_key", thi.alias("_hi"), tlo.alias("_lo"))
    found = contaminated(docs, items, key, text, item_key, item_text)
    return rows.join(found, (F.col("_hi") == F.col("thi")) & (F.col("_lo") == F.col("tlo"))).select(
        F.col("_key").alias(key), F.col("item").alias(item_key), "similarity", F.col("start").alias("start_word"), "distance")


def drop_leaking(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the rows whose text holds a benchmark item; columns as they were."""
    thi, tlo = wide_key(whole_text(docs[text]))
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"), thi.alias("_hi"), tlo.alias("_lo"))
    found = checked_broadcast(contaminated(docs, items, key, text).select("thi", "tlo").distinct())
    return rows.join(found, (F.col("_hi") == F.col("thi")) & (F.col("_lo") == F.col("tlo")), "left_anti").select("_row.*")
