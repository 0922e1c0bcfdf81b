"""H1-H3 (headers of raw sheets) and P1-P5 (profiles, column roles, samples,
summaries).

Driver-side work is limited to metadata: H1 looks at the first 10 rows, H2/H3 turn
one header row into names. Profiles are single aggregation passes over all columns
whose one-row result is turned into one row per column with ``inline``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tableops.functions.exprs import (
    number_in,
    as_list, kind, not_nan, numeric_columns, orderable, require,
)
from tableops.functions.text import squash
from tableops.operators.aggregate import summary_stats
from tableops.plans.selection import rows_at

# Header-score weights, the rows scanned, and the column-role keywords
# and uniqueness thresholds of the reference's profiler.
HEADER_SCAN_ROWS = 10
W_NON_NULL, W_TEXT, W_UNIQUE = 0.4, 0.4, 0.2
ENTITY_KEYWORDS = ["name", "id", "student", "employee", "person", "customer", "user", "member"]
CONTEXT_KEYWORDS = ["type", "category", "group", "class", "grade", "level", "status",
                    "segment", "division", "section"]
ENTITY_RATIO = 0.5
CONTEXT_RATIO = 0.3

#: HyperLogLog sketch: log2 of its registers, and six standard errors of it.
SKETCH_SIZE, SKETCH_ERROR = 14, 0.05
#: Frequent-items sketch: values tracked a column, and those it hands over.
TRACKED, CANDIDATES = 10_000, 16


def _data_cols(raw: DataFrame, index: str) -> list[str]:
    return [c for c in raw.columns if c != index]


def detect_header(raw: DataFrame, index: str = "row_ix") -> int:
    """H1: the row (among the first 10) that looks most like a header; the first row
    wins ties and 0 is returned when no row scores above 0."""
    cols = _data_cols(raw, index)
    n = float(len(cols))
    if n == 0:
        return 0
    vals = F.array(*[F.col(c).cast("string") for c in cols])
    present = F.filter(vals, lambda v: v.isNotNull())
    numeric = F.filter(present, lambda v: number_in(F.regexp_replace(v, ",", "")).isNotNull())
    score = (F.size(present) / n * W_NON_NULL
             + (F.size(present) - F.size(numeric)) / n * W_TEXT
             + F.size(F.array_distinct(present)) / n * W_UNIQUE)
    best = (raw.filter(F.col(index) < HEADER_SCAN_ROWS)
            .select(F.col(index), score.alias("_score"))
            .filter(F.col("_score") > 0)
            .orderBy(F.col("_score").desc(), F.col(index).asc()).limit(1).collect())
    return int(best[0][index]) if best else 0


def _clean_name(v) -> str:
    if v is None:
        return ""
    return " ".join(str(v).split())


def unique_names(names: Sequence) -> list[str]:
    """H3: names made unique with ``_2``, ``_3`` ... suffixes. Blank, NULL and ``nan``
    become ``Column``. A generated name is re-checked against every name already
    used, so ``A, A, A_2`` gives ``A, A_2, A_2_2`` (the reference emits ``A_2`` twice)."""
    used: set[str] = set()
    counts: dict[str, int] = {}
    out = []
    for raw in names:
        base = _clean_name(raw)
        if base == "" or base.lower() == "nan":
            base = "Column"
        name = base
        if name in used:
            k = counts.get(base, 1)
            while True:
                k += 1
                name = f"{base}_{k}"
                if name not in used:
                    break
            counts[base] = k
        used.add(name)
        out.append(name)
    return out


def apply_header(raw: DataFrame, row: int, index: str = "row_ix",
                 keep_index: bool = False) -> DataFrame:
    """H2: use row ``row`` as column names (line breaks and blank runs squashed;
    blank names become ``Column_<position>``; then H3), and keep only the rows after
    it. Only the header row itself is brought to the driver."""
    cols = _data_cols(raw, index)
    hdr = raw.filter(F.col(index) == row).select(*[squash(c).alias(c) for c in cols]).collect()
    values = list(hdr[0]) if hdr else [None] * len(cols)
    names = [v if v else f"Column_{i + 1}" for i, v in enumerate(values)]
    names = unique_names(names)
    body = raw.filter(F.col(index) > row)
    sel = [F.col(c).alias(n) for c, n in zip(cols, names)]
    if keep_index:
        sel.append(F.col(index))
    return body.select(*sel)


def _column_facts(df: DataFrame, distinct: bool, approx: bool = False) -> DataFrame:
    """One row per column from ONE aggregation over all columns: ``column, position,
    dtype, kind, rows, non_null, nulls`` and, with ``distinct``, ``role`` and
    ``unique_ratio`` (exact distinct counts, or HyperLogLog with ``approx``)."""
    fields = df.schema.fields
    aggs = [F.count(F.lit(1)).alias("_rows")]
    aggs += [F.count(not_nan(df, f.name)).alias(f"_c{i}") for i, f in enumerate(fields)]
    if distinct:
        dc = F.approx_count_distinct if approx else F.count_distinct
        aggs += [dc(not_nan(df, f.name)).alias(f"_d{i}") for i, f in enumerate(fields)]
    one = df.agg(*aggs)
    rows = F.col("_rows")
    structs = []
    for i, f in enumerate(fields):
        cols = [F.lit(f.name).alias("column"), F.lit(i).alias("position"),
                F.lit(f.dataType.simpleString()).alias("dtype"), F.lit(kind(f.dataType)).alias("kind"),
                rows.alias("rows"), F.col(f"_c{i}").alias("non_null"),
                (rows - F.col(f"_c{i}")).alias("nulls")]
        if distinct:
            ratio = F.when(rows > 0, F.col(f"_d{i}") / rows).otherwise(F.lit(0.0))
            cols += [_role(f.name, kind(f.dataType), F.col(f"_c{i}"), ratio).alias("role"),
                     ratio.alias("unique_ratio")]
        structs.append(F.struct(*cols))
    return one.select(F.inline(F.array(*structs)))


def profile(df: DataFrame) -> DataFrame:
    """One row per column: ``column, position, dtype, kind, rows, non_null,
    nulls`` from ONE aggregation over all columns."""
    return _column_facts(df, distinct=False)


def _role(name: str, k: str, non_null, ratio):
    """Column role rule (expression over the aggregated counts)."""
    low = name.lower()
    ent_kw = any(w in low for w in ENTITY_KEYWORDS)
    ctx_kw = any(w in low for w in CONTEXT_KEYWORDS)
    if k == "date":
        typed = F.lit("date")
    elif k in ("numeric", "bool"):
        typed = F.lit("measure")
    else:
        is_entity = F.lit(ent_kw) | (ratio > ENTITY_RATIO)
        is_context = F.lit(ctx_kw) | (ratio < CONTEXT_RATIO)
        # text that is not clearly an entity, by name or ratio, describes the context
        typed = F.when(is_context | ~is_entity, F.lit("context")).otherwise(F.lit("entity"))
    return F.when(non_null == 0, F.lit("unknown")).otherwise(typed)


def classify_columns(df: DataFrame, approx: bool = False) -> DataFrame:
    """``column, role, unique_ratio`` per column. Roles: ``unknown`` (all NULL),
    ``date``, ``measure`` (numeric or boolean), else text is ``entity`` when its name
    has an entity keyword or more than half the rows are distinct, ``context`` when
    its name has a context keyword or fewer than 30% are distinct (context wins),
    and 30-50% without keyword is ``context``. ``unique_ratio`` = distinct non-NULL
    values / rows. One aggregation; ``approx=True`` counts distinct values with
    HyperLogLog instead of an exact (Expand-based) distinct count."""
    return _column_facts(df, distinct=True, approx=approx).select("column", "role", "unique_ratio")


def column_roles(df: DataFrame) -> DataFrame:
    """``column, role`` as ``classify_columns`` gives them, without its exact distinct
    counts.

    A role needs at most one comparison of a text column's distinct ratio: with 0.3 if the
    name has an entity keyword, with 0.5 if it has none. One pass keeps a HyperLogLog sketch
    of each such column; only those whose estimate lies within SKETCH_ERROR of the threshold are counted
    exactly, in a second pass over them alone. Both are run when this is called; one row
    reaches the driver."""
    texts = {}
    for f in df.schema.fields:
        low = f.name.lower()
        if kind(f.dataType) not in ("date", "numeric", "bool") and not any(w in low for w in CONTEXT_KEYWORDS):
            texts[f.name] = CONTEXT_RATIO if any(w in low for w in ENTITY_KEYWORDS) else ENTITY_RATIO
    fields = df.schema.fields
    sketched = [n for n in texts if kind(df.schema[n].dataType) == "text"]
    aggs = [F.count(not_nan(df, f.name)).alias(f"c{i}") for i, f in enumerate(fields)]
    aggs += [F.hll_sketch_estimate(F.hll_sketch_agg(n, SKETCH_SIZE)).alias(f"d{i}") for i, n in enumerate(sketched)]
    one = df.agg(F.count(F.lit(1)).alias("rows"), *aggs).first()
    rows = one["rows"]
    distinct = {n: one[f"d{i}"] or 0 for i, n in enumerate(sketched)}
    close = [n for n in texts if n not in distinct or abs(distinct[n] - texts[n] * rows) <= SKETCH_ERROR * distinct[n]]
    if close and rows:
        exact = df.agg(*[F.count_distinct(F.col(n)).alias(f"d{i}") for i, n in enumerate(close)]).first()
        distinct |= {n: exact[f"d{i}"] for i, n in enumerate(close)}
    found = [F.struct(F.lit(f.name).alias("column"), _role(
        f.name, kind(f.dataType), F.lit(one[f"c{i}"]), F.lit(distinct.get(f.name, 0) / rows if rows else 0.0)).alias("role"))
        for i, f in enumerate(fields)]
    return df.sparkSession.range(1).select(F.inline(F.array(*found)))


def top_values(df: DataFrame, tracked: int = TRACKED) -> DataFrame:
    """A8 for every column: ``column``, its most frequent non-NULL value as text (``top``, ties
    to the smaller one) and ``top_count``, exactly.

    One pass keeps a frequent-items sketch of the values' hashes, ``tracked`` a column however long
    the values are. Where it proves that every other value is rarer than the best, only the
    values that may be the best are counted, so that next to nothing is shuffled; a column
    without such a proof (nearly unique, or of many equally frequent values) is counted whole.
    The sketches are made when this is called."""
    size = 1 << (4 * tracked // 3 - 1).bit_length()
    hashes = [F.xxhash64(F.col(c).cast("string")) for c in df.columns]
    seen = df.select(*[F.when(F.col(c).isNotNull(), h).alias(f"h{i}") for i, (c, h) in enumerate(zip(df.columns, hashes))])
    one = seen.agg(F.count(F.lit(1)).alias("rows"), *[
        F.expr(f"approx_top_k(h{i}, {CANDIDATES}, {tracked})").alias(f"h{i}") for i in range(len(df.columns))]).first()
    error = 7 * one["rows"] / size  # twice the sketch's own bound
    cells = []
    for i, (c, h) in enumerate(zip(df.columns, hashes)):
        top = [(x["item"], x["count"]) for x in one[f"h{i}"] if x["item"] is not None]
        best = max((n for _, n in top), default=0)
        may = [v for v, n in top if n >= best - error]
        others = min(n for _, n in top) if len(one[f"h{i}"]) >= CANDIDATES and top else 0
        proven = bool(top) and best - error > max(others, 2 * error)
        value = F.col(c).cast("string")
        cells.append(F.struct(F.lit(c).alias("column"), (F.when(h.isin(may), value) if proven else value).alias("value")))
    counted = (df.select(F.inline(F.array(*cells))).filter(F.col("value").isNotNull())
               .groupBy("column", "value").count())
    best = F.min_by(F.struct(F.col("value").alias("top"), F.col("count").alias("top_count")),
                    F.struct((-F.col("count")).alias("n"), F.col("value")))
    return counted.groupBy("column").agg(best.alias("_t")).select("column", "_t.top", "_t.top_count")


def region_sample(df: DataFrame, order_by: Sequence[str], n: int = 3) -> DataFrame:
    """P3 (comprehensive sample): first ``n`` rows; the middle ``n`` (from position
    ``rows // 2 - n // 2``) when rows > 3n; the last ``n`` when rows > 2n. Ascending by
    ``order_by``, NULL last, ties broken by all columns. ``region`` says where each row came
    from, ``row_ix`` its position.

    The table is neither sorted nor copied: head and tail are top-n, the middle is selected by
    split points and block counts (``plans.selection``). Rows are counted when this is called."""
    order_by = as_list(order_by)
    require(df, order_by)
    names = order_by + [f.name for f in df.schema.fields if f.name not in order_by and orderable(f.dataType)]
    total = df.count()
    mid = total // 2 - n // 2

    def region(rows: DataFrame, name: str) -> DataFrame:
        return rows.withColumn("region", F.lit(name))
    out = region(rows_at(df, names, 0, n, total, few=total), "head")  # a plain top-n
    if total > 3 * n:
        out = out.unionByName(region(rows_at(df, names, mid, mid + n, total), "middle"))
    if total > 2 * n:
        down = [F.col(c).desc_nulls_first() for c in names]
        ix = F.lit(total) - F.row_number().over(Window.orderBy(*down))
        out = out.unionByName(region(df.orderBy(*down).limit(n).withColumn("row_ix", ix.cast("long")), "tail"))
    return out


def data_profile(df: DataFrame, approx: bool = False) -> DataFrame:
    """Per column the structure profile (P1), role and distinct ratio (P2), the
    describe statistics for numeric columns (A6), and the most frequent value with
    its count (A8; ties to the smaller value)."""
    facts = _column_facts(df, distinct=True, approx=approx)  # P1 + P2 in one pass
    nums = numeric_columns(df)
    stats = summary_stats(df, nums, approx).withColumnRenamed("Column", "column") \
        .drop("Count") if nums else None
    top = top_values(df)
    out = facts
    if stats is not None:
        out = out.join(stats, "column", "left")
    return out.join(top, "column", "left")


def summary_table(df: DataFrame, keys: str | Sequence[str], count: str = "Count") -> DataFrame:
    """P5 (summary_sheet / export_summary): per group the row count and the sum of
    every numeric column (NULL keys dropped)."""
    keys = as_list(keys)
    require(df, keys)
    nums = numeric_columns(df, exclude=keys)
    base = df
    for k in keys:
        base = base.filter(F.col(k).isNotNull())
    return base.groupBy(*keys).agg(F.count(F.lit(1)).alias(count), *[
        F.coalesce(F.sum(not_nan(df, c)), F.lit(0)).alias(c) for c in nums])


def export_summary(df: DataFrame, keys: str | Sequence[str], out: str, fmt: str = "parquet",
                   count: str = "Count") -> str:
    """P5 (export_summary): write ``summary_table`` as a new table (never over an
    existing one) and return its path."""
    summary_table(df, keys, count).write.mode("errorifexists").format(fmt).save(out)
    return out
