"""Key lookups and joins.

Join strategy is left to Catalyst and AQE: a small side is broadcast only when its
measured size (file statistics, or the materialised shuffle output under AQE) is
below ``spark.sql.autoBroadcastJoinThreshold``; otherwise sort-merge join, with AQE
splitting skewed partitions. No join here is hinted blindly.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tableops.functions.exprs import as_list, require
from tableops.functions.text import normalized
from tableops.plans.lineage import cut_lineage

HOWS = ("left", "right", "inner", "outer")


def _last_per_key(ref: DataFrame, key: str, return_col: str,
                  order_by: Sequence[str] | None) -> DataFrame:
    """One row per key: the value of the LAST row in ``order_by`` order (NULLs sort
    first, so a NULL order value is never last unless all are); rows tied on
    ``order_by`` are broken by the larger value, which makes the choice
    deterministic. ``max`` of a small struct is an aggregate, so a hot key is
    reduced map-side to one partial row per task."""
    order = [o for o in as_list(order_by)]
    if not order:
        order = [c for c in ref.columns if c not in (key, return_col)]
    fields = []
    for i, o in enumerate(order):
        fields += [F.col(o).isNotNull().alias(f"n{i}"), F.col(o).alias(f"o{i}")]
    fields += [F.col(return_col).isNotNull().alias("nv"), F.col(return_col).alias("v")]
    return ref.groupBy(F.col(key).alias("_k")).agg(F.max(F.struct(*fields)).alias("_m")) \
              .select("_k", F.col("_m.v").alias("_v"))


def lookup(df: DataFrame, ref: DataFrame, key: str, return_col: str,
           out: str | None = None, order_by: Sequence[str] | None = None,
           ref_key: str | None = None) -> DataFrame:
    """J1 (vlookup / xlookup / lookup): add ``out`` = ``ref.return_col`` of the row
    whose ``ref_key`` equals ``df.key``. The last duplicate key in ``order_by`` order
    wins (rows tied on ``order_by`` give the larger value; without ``order_by`` all
    other columns order the rows), NULL matches NULL, a miss is NULL and the row
    count of ``df`` never changes. Missing columns raise (the reference skips
    silently)."""
    ref_key = ref_key or key
    require(df, [key])
    require(ref, [ref_key, return_col])
    out = out or f"{return_col}_lookup"
    reduced = _last_per_key(ref, ref_key, return_col, order_by)
    j = df.join(reduced, df[key].eqNullSafe(reduced["_k"]), "left")
    return j.drop("_k").withColumnRenamed("_v", out)


def index_match(df: DataFrame, key: str, return_col: str, out: str,
                order_by: Sequence[str] | None = None) -> DataFrame:
    """Each row gets the value of ``return_col`` from the LAST row (in
    ``order_by`` order) that has the same ``key``; NULL keys share one value.

    Computed as a per-key ``max_by`` aggregate joined back on the key, rather than
    a window over each key: the aggregate is reduced map-side and the join's hot
    key is split by AQE, whereas a window would put a hot key's rows in one task."""
    require(df, [key, return_col])
    reduced = _last_per_key(df, key, return_col, order_by)
    j = df.join(reduced, df[key].eqNullSafe(reduced["_k"]), "left")
    return j.drop("_k").withColumnRenamed("_v", out)


def join_tables(df: DataFrame, ref: DataFrame, key: str, how: str = "left",
                suffixes: tuple[str, str] = ("_x", "_y")) -> DataFrame:
    """J3 (join_sheets / merge): equi-join on a column both tables have. NULL keys
    match each other (pandas merge); non-key columns present on both sides get
    ``_x`` / ``_y`` suffixes; the key appears once (coalesced for right/outer).
    ``how`` is left, right, inner or outer (cross raises)."""
    how = how.lower()
    if how == "full":
        how = "outer"
    if how not in HOWS:
        raise ValueError(f"join type {how!r} not in {HOWS}")
    require(df, [key])
    require(ref, [key])
    clash = (set(df.columns) & set(ref.columns)) - {key}
    lcols = [c for c in df.columns]
    rcols = [c for c in ref.columns if c != key]
    l = df.select(*[F.col(c).alias(("_L_" + c) if c == key else (c + suffixes[0] if c in clash else c))
                    for c in lcols])
    r = ref.select(F.col(key).alias("_R_" + key),
                   *[F.col(c).alias(c + suffixes[1] if c in clash else c) for c in rcols])
    j = l.join(r, F.col("_L_" + key).eqNullSafe(F.col("_R_" + key)), how)
    keycol = (F.coalesce(F.col("_L_" + key), F.col("_R_" + key)) if how in ("right", "outer")
              else F.col("_L_" + key)).alias(key)
    out = []
    for c in lcols:
        out.append(keycol if c == key else F.col(c + suffixes[0] if c in clash else c))
    out += [F.col(c + suffixes[1] if c in clash else c) for c in rcols]
    return j.select(*out)


# --- J4: fuzzy match -------------------------------------------------------------

def _pieces(text: Column, lengths: Column) -> Column:
    """Distinct substrings of ``text`` whose length is one of ``lengths``."""
    return F.array_distinct(F.flatten(F.transform(
        F.filter(lengths, lambda n: n <= F.length(text)),
        lambda n: F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substring(text, i, n)))))


def _nonempty(a: Column) -> Column:
    return F.filter(a, lambda w: w != "")


def _size_class(text: Column) -> Column:
    """The greatest power of two that is not above the text's length."""
    return F.call_function("shiftleft", F.lit(1), F.floor(F.log2(F.length(text) + F.lit(0.5))).cast("int"))


def occurrences(keys: DataFrame, texts: DataFrame, text: str) -> DataFrame:
    """The rows of ``texts`` with every ``_key`` of ``keys`` (distinct, not empty) that occurs in
    their column ``text``.

    An inverted index instead of all substrings: a text is entered under its pieces of the
    key sizes rounded down to powers of two, so that its entries are its length times a few
    sizes. A key looks up one piece only, the one that fewest texts hold, and is not looked up at
    all if one of its pieces is in no text; then the whole key is compared."""
    sizes = F.coalesce(keys.select(F.collect_set(_size_class(F.col("_key"))).alias("_l")).scalar(), F.array().cast("array<int>"))
    entered = texts.withColumn("_ls", sizes).select(*texts.columns, F.explode(_pieces(F.col(text), F.col("_ls"))).alias("_piece"))
    pieces = keys.select("_key", F.explode(_pieces(F.col("_key"), F.array(_size_class(F.col("_key"))))).alias("_piece"))
    held = entered.join(pieces.select("_piece").distinct(), "_piece", "left_semi") \
        .groupBy("_piece").agg(F.count(F.lit(1)).alias("_n"))
    rarest = pieces.join(held, "_piece", "left").groupBy("_key").agg(
        F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), "_piece")).alias("_r")) \
        .filter("_r.n > 0").select("_key", F.col("_r._piece").alias("_piece"))
    return entered.join(rarest, "_piece").filter(F.contains(F.col(text), F.col("_key"))).select(*texts.columns, "_key")


def fuzzy_match(df: DataFrame, ref: DataFrame, left: str, right: str, out: str,
                tier: str | None = None) -> DataFrame:
    """For each row of ``df`` one ``ref.right`` value that ``token_match``es ``df.left``
    (F8), NULL when none does. The row count is unchanged.

    The best way to match decides, on the normalised texts: 1 equal, 2 the term occurs in the
    value, 3 the value occurs in the term, 4 a token of the term occurs in the value, 5 a word
    of the value occurs in the term, 6 a value's word shares the term's first three letters;
    then the shortest value, then the smallest. ``tier`` names a column for that number.

    Within one way the choice depends on the value alone, so every key (a whole value, a
    piece of a value, a word, a prefix) keeps one winner by an aggregate, and no list of pairs
    is made however many terms and values share a prefix. What occurs in a text is found by
    ``occurrences``, at any length."""
    require(df, [left])
    require(ref, [right])
    terms = df.select(F.lower(normalized(left)).alias("_t")).filter(F.col("_t") != "").distinct()
    values = ref.select(F.col(right).alias("_v"), F.lower(normalized(right)).alias("_n")) \
        .filter(F.col("_n") != "").groupBy("_n").agg(F.min("_v").alias("_v")) \
        .select("_n", F.struct(F.length("_n").alias("len"), "_n", "_v").alias("_val"))
    t, n = F.col("_t"), F.col("_n")
    words = F.array_distinct(_nonempty(F.split(F.translate(n, "()", "  "), " ")))

    def winners(keys: DataFrame, kind: str) -> DataFrame:
        return keys.groupBy("_key").agg(F.min("_val").alias("_val")).select(F.lit(kind).alias("_kind"), "_key", "_val")

    worded = values.select(F.explode(words).alias("_key"), "_val")
    asked = terms.select(F.lit(2).alias("_tier"), "_t", t.alias("_key")).unionByName(
        terms.select(F.lit(4).alias("_tier"), "_t", F.explode(F.array_distinct(F.split(t, " "))).alias("_key")))
    wanted = asked.select("_key").distinct()
    held = occurrences(wanted, values, "_n").select("_key", "_val")
    whole = values.select(n.alias("_key"), "_val")
    offered = winners(whole, "whole").unionByName(winners(worded, "word")).unionByName(winners(held, "piece")) \
        .unionByName(winners(worded.filter(F.length("_key") >= 3).withColumn("_key", F.substring("_key", 1, 3)), "prefix"))
    inner = whole.select("_key").unionByName(worded.select("_key")).distinct()
    found_in = occurrences(inner, terms, "_t")
    lookups = terms.select(F.lit(1).alias("_tier"), F.lit("whole").alias("_kind"), "_t", t.alias("_key")) \
        .unionByName(asked.select("_tier", F.lit("piece").alias("_kind"), "_t", "_key")) \
        .unionByName(found_in.select(F.lit(3).alias("_tier"), F.lit("whole").alias("_kind"), "_t", "_key")) \
        .unionByName(found_in.select(F.lit(5).alias("_tier"), F.lit("word").alias("_kind"), "_t", "_key")) \
        .unionByName(terms.filter(F.length(t) >= 3).select(
            F.lit(6).alias("_tier"), F.lit("prefix").alias("_kind"), "_t", F.substring(t, 1, 3).alias("_key")))
    best = lookups.join(offered, ["_kind", "_key"]).groupBy("_t").agg(F.min(F.struct("_tier", "_val")).alias("_b"))
    j = df.withColumn("_t", F.lower(normalized(left))).join(best, "_t", "left")
    cols = [F.col(c) for c in df.columns] + [F.col("_b._val._v").alias(out)]
    if tier:
        cols.append(F.col("_b._tier").alias(tier))
    return j.select(*cols)


# --- J4: nearest spelling --------------------------------------------------------

#: A part whose terms times values are more than this is split by the text beside it.
HOT_PAIRS = 20_000
#: So many hot parts are broadcast at most, as counted.
FEW = 200_000


def _cuts(length: Column, edits: Column) -> Column:
    """A text of ``length`` cut into ``edits`` + 1 even parts: number, place from 0 and length."""
    def place(j: Column) -> Column:
        return F.floor(j * length / (edits + 1)).cast("int")
    return F.transform(F.sequence(F.lit(0), edits), lambda j: F.struct(
        j.alias("j"), place(j).alias("at"), (place(j + 1) - place(j)).alias("n")))


def _entered(text: Column, edits: Column) -> Column:
    """The parts under which a value is entered."""
    return F.transform(_cuts(F.length(text), edits), lambda c: F.struct(
        c["j"].alias("j"), F.substring(text, c["at"] + 1, c["n"]).alias("part"), c["at"].alias("from")))


def _looked_up(text: Column, length: Column, edits: Column) -> Column:
    """The parts under which a term looks up values of ``length``: where it is within ``edits``
    of one, one of the value's parts stands in it, shifted by what the edits on either side
    allow."""
    more = F.length(text) - length

    def shifted(c: Column) -> Column:
        places = F.sequence(F.greatest(F.lit(0), c["at"] - F.floor((edits - more) / 2).cast("int")),
                            c["at"] + F.floor((edits + more) / 2).cast("int"))
        return F.transform(F.filter(places, lambda s: s + c["n"] <= F.length(text)), lambda s: F.struct(
            c["j"].alias("j"), F.substring(text, s + 1, c["n"]).alias("part"), s.alias("from")))
    return F.when(F.abs(more) > edits, F.array().cast("array<struct<j:int,part:string,from:int>>")).otherwise(
        F.flatten(F.transform(_cuts(length, edits), shifted)))


def _shortened(text: Column, edits: int) -> Column:
    """The distinct texts that are left when at most ``edits`` characters are deleted."""
    def one_less(v: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.length(v)), lambda i: F.concat(
            F.substring(v, F.lit(1), i - 1), F.substring(v, i + 1, F.length(v))))
    level = out = F.array(text)
    for _ in range(edits):
        level = F.array_distinct(F.flatten(F.transform(F.filter(level, lambda v: v != ""), one_less)))
        out = F.concat(out, level)
    return F.array_distinct(out)


def _beside(rows: DataFrame, text: str, key: list[str], edits: int) -> DataFrame:
    """Rows of a hot part once more, by what stands beside it, up to ``edits`` deletions: two
    texts within that distance have one of these in common."""
    beside = F.concat(F.substring(F.col(text), F.lit(1), F.col("from")), F.lit("\0"),
                      F.substring(F.col(text), F.col("from") + F.length("part") + 1, F.length(text)))
    return rows.select(text, *key, F.explode(F.transform(_shortened(beside, edits), lambda v: F.xxhash64(v))).alias("_beside"))


def _merged(one: DataFrame, two: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """A join that broadcasts no side. Spark estimates rows from an explode by the size of
    the compressed file and the rows before it, and would send what is many times larger
    through the driver."""
    return one.join(two.hint("merge"), on, how)


def nearest_match(df: DataFrame, ref: DataFrame, left: str, right: str, out: str, max_edits: int = 2,
                  distance: str | None = None, hot_pairs: int = HOT_PAIRS) -> DataFrame:
    """J4, best by edit distance: for each row of ``df`` the ``ref.right`` value of least
    Levenshtein distance to ``df.left``, NULL where none is within ``max_edits``. Texts are
    compared normalised and in lower case; of equal distances the shortest value wins, then the
    smallest. Blank terms and values never match; the row count is unchanged. ``distance``
    names a column for the distance.

    A value is entered under each of its ``max_edits`` + 1 parts; a term within the distance
    has one of them unchanged at nearly the same place, so an equi-join of parts finds every
    candidate, whose distance is then computed. A part that many terms and values share (a common
    beginning of keys) is not joined alone, but together with the text beside it, less up to
    ``max_edits`` characters; those entries grow with the text's length to that power, and only
    such parts have them."""
    require(df, [left])
    require(ref, [right])
    if max_edits < 0:
        raise ValueError("max_edits is negative")
    k = F.lit(max_edits)
    terms = df.select(F.lower(normalized(left)).alias("_t")).filter(F.col("_t") != "").distinct()
    values = ref.select(F.col(right).alias("_v"), F.lower(normalized(right)).alias("_n")) \
        .filter(F.col("_n") != "").groupBy("_n").agg(F.min("_v").alias("_v"))
    held = values.select("_n", F.length("_n").alias("len"), F.inline(_entered(F.col("_n"), k)))
    asked = terms.select("_t", F.explode(F.sequence(F.greatest(F.lit(1), F.length("_t") - k), F.length("_t") + k)).alias("len")) \
        .select("_t", "len", F.inline(_looked_up(F.col("_t"), F.col("len"), k)))
    key = ["len", "j", "part"]
    hot = cut_lineage(_merged(held.groupBy(*key).agg(F.count(F.lit(1)).alias("_a")), asked.groupBy(*key).agg(F.count(F.lit(1)).alias("_b")), key)
                      .filter(F.col("_a") * F.col("_b") > hot_pairs).select(*key))
    hot = hot.hint("broadcast" if hot.count() <= FEW else "merge")
    plain = _merged(held.join(hot, key, "left_anti").select("_n", *key), asked.join(hot, key, "left_anti").select("_t", *key), key)
    split = _merged(_beside(held.join(hot, key, "left_semi"), "_n", key, max_edits),
                    _beside(asked.join(hot, key, "left_semi"), "_t", key, max_edits), [*key, "_beside"])
    # a pair may be met several times, which a minimum does not mind
    near = plain.select("_t", "_n").unionByName(split.select("_t", "_n")) \
        .withColumn("_d", F.levenshtein("_t", "_n", max_edits)).filter("_d >= 0")
    best = near.groupBy("_t").agg(F.min(F.struct("_d", F.length("_n").alias("_l"), "_n")).alias("_m")) \
        .select("_t", "_m._d", "_m._n")
    best = _merged(best, values, ["_n"]).select("_t", F.struct("_d", "_v").alias("_b"))
    j = _merged(df.withColumn("_t", F.lower(normalized(left))), best, ["_t"], "left")
    cols = [F.col(c) for c in df.columns] + [F.col("_b._v").alias(out)]
    if distance:
        cols.append(F.col("_b._d").alias(distance))
    return j.select(*cols)
