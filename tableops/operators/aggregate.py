"""A1-A10: grouping, pivots, cross tabs, describe, subtotals, rollups.

All aggregations are plain ``groupBy().agg()`` / ``rollup`` / ``cube``: partial
aggregation runs before the shuffle, so a hot key costs one partial row per task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tableops.functions.exprs import (
    as_list, is_numeric, not_nan, null_safe_eq, numeric_columns, require,
)
from tableops.plans.quantiles import exact_quantiles

AGGS = ("sum", "mean", "count", "min", "max", "median", "std")
_ALIASES = {"average": "mean", "avg": "mean", "minimum": "min", "maximum": "max",
            "std_dev": "std", "stddev": "std"}


def check_fn(fn: str) -> str:
    """Canonical aggregate name; unknown names raise (the reference silently sums)."""
    f = _ALIASES.get(fn.lower(), fn.lower())
    if f not in AGGS:
        raise ValueError(f"unknown aggregate {fn!r}; expected one of {AGGS}")
    return f


def agg_expr(df: DataFrame, c: str, fn: str, approx: bool = False) -> Column:
    """One aggregate with pandas null rules: sum of an all-NULL group is 0, count
    counts non-NULL cells, std is the sample deviation (NULL for one row).
    ``approx=True`` turns the exact median (distinct values held per group) into a
    bounded-memory sketch."""
    x = not_nan(df, c)
    fn = fn.lower()
    if fn == "sum":
        return F.coalesce(F.sum(x), F.lit(0).cast("double" if not _integral(df, c) else "long"))
    if fn in ("mean", "average", "avg"):
        return F.avg(x)
    if fn == "count":
        return F.count(x)
    if fn in ("min", "minimum"):
        return F.min(x)
    if fn in ("max", "maximum"):
        return F.max(x)
    if fn == "median":
        return F.percentile_approx(x, 0.5, 10000) if approx else F.median(x)
    if fn in ("std", "std_dev", "stddev"):
        return F.stddev_samp(x)
    raise ValueError(f"unknown aggregate {fn!r}; expected one of {AGGS}")


def _integral(df: DataFrame, c: str) -> bool:
    from pyspark.sql import types as T
    return isinstance(df.schema[c].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))


def _keys_not_null(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Drop rows whose key is NULL (or NaN in a float key), as pandas grouping does."""
    cond = None
    for k in keys:
        e = not_nan(df, k).isNotNull()
        cond = e if cond is None else cond & e
    return df.filter(cond) if cond is not None else df


def aggregate(df: DataFrame, keys: Sequence[str],
              specs: Sequence[tuple[str, str, str]], approx: bool = False) -> DataFrame:
    """``(column, fn, alias)`` aggregates per ``keys`` (or over the whole table when
    ``keys`` is empty). Every function but ``median`` runs in one partial/final
    aggregation. An exact median is a distributed rank selection
    (``plans.quantiles``): per group it is joined back on the keys, overall it is a
    scalar subquery; a hot group never sits in one aggregation buffer.
    ``approx=True`` computes ``percentile_approx`` inside the single aggregation."""
    keys = as_list(keys)
    medians = [] if approx else [(c, a) for c, f, a in specs if f.lower() == "median"]
    plain = [(c, f, a) for c, f, a in specs if approx or f.lower() != "median"]
    exprs = [agg_expr(df, c, f, approx).alias(a) for c, f, a in plain] or [F.count(F.lit(1)).alias("_n")]
    out = df.groupBy(*keys).agg(*exprs) if keys else df.agg(*exprs)
    if not keys:
        for c, a in medians:
            out = out.withColumn(a, exact_quantiles(df, not_nan(df, c), [0.5]).select("q0").scalar())
    elif medians:
        if len(medians) == 1:
            c, a = medians[0]
            med = exact_quantiles(df, not_nan(df, c), [0.5], by=keys, prefix="_m") \
                .withColumnRenamed("_m0", a)
        else:
            # several medians share ONE distributed sort: values in long form, the
            # column index as an extra group key, pivoted back (one row per group)
            long = None
            for i, (c, _) in enumerate(medians):
                part = df.select(*keys, F.lit(i).alias("_mc"), not_nan(df, c).cast("double").alias("_mv"))
                long = part if long is None else long.unionByName(part)
            q = exact_quantiles(long, "_mv", [0.5], by=keys + ["_mc"], prefix="_m")
            med = q.groupBy(*keys).pivot("_mc", list(range(len(medians)))).agg(F.first("_m0"))
            med = med.select(*keys, *[F.col(str(i)).alias(a) for i, (_, a) in enumerate(medians)])
        med = med.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
                         *[F.col(a) for _, a in medians])
        out = out.join(med, null_safe_eq([F.col(k) for k in keys],
                                          [F.col(f"_k{i}") for i in range(len(keys))]), "left")
        out = out.drop(*[f"_k{i}" for i in range(len(keys))])
    return out.select(*keys, *[a for _, _, a in specs])


def group_by(df: DataFrame, keys: str | Sequence[str],
             aggs: Mapping[str, str] | Sequence[tuple[str, str, str]],
             approx: bool = False) -> DataFrame:
    """A1: group on ``keys`` (rows with a NULL key are dropped, as pandas does) and
    aggregate. ``aggs`` is ``{column: fn}`` (result keeps the column name) or a list of
    ``(column, fn, alias)``; fn is one of sum, mean, count, min, max, median, std.
    Unknown function names raise. See ``aggregate`` for how medians stay exact
    without a hot task."""
    keys = as_list(keys)
    require(df, keys)
    specs = [(c, f, c) for c, f in aggs.items()] if isinstance(aggs, Mapping) else list(aggs)
    require(df, [c for c, _, _ in specs])
    for _, f, _ in specs:
        check_fn(f)
    return aggregate(_keys_not_null(df, keys), keys, specs, approx)


def group_count(df: DataFrame, keys: str | Sequence[str], out: str = "Count") -> DataFrame:
    """A2: rows per key (NULL keys dropped)."""
    keys = as_list(keys)
    require(df, keys)
    return _keys_not_null(df, keys).groupBy(*keys).agg(F.count(F.lit(1)).alias(out))


def pivot_table(df: DataFrame, index: str | Sequence[str], column: str,
                value: str | None = None, fn: str = "sum",
                values: Sequence | None = None, approx: bool = False) -> DataFrame:
    """A3/A4: one row per ``index``, one column per distinct ``column`` value, cells
    ``fn(value)`` (or row counts when ``value`` is None); gaps are 0. NULL index or
    column keys are dropped. Cells are aggregated first (``aggregate``: partial
    aggregation, exact medians without a hot task); the pivot then reshapes one
    row per cell. For ``mean`` an index row whose every cell is NULL is
    dropped before filling, as pandas does.

    Pass ``values`` (the pivot column values) to skip the extra distinct-values job
    and to bound the width; otherwise Spark collects the distinct values (capped by
    ``spark.sql.pivotMaxValues``)."""
    index = as_list(index)
    require(df, index + [column] + ([value] if value else []))
    base = _keys_not_null(df, index + [column])
    if value is None:
        cells_df = base.groupBy(*index, column).agg(F.count(F.lit(1)).alias("_cell"))
    else:
        check_fn(fn)
        cells_df = aggregate(base, index + [column], [(value, fn, "_cell")], approx)
    if values is None:
        values = _pivot_values(base, column)
    # the pivot runs over one row per (index, column) cell, not over the input rows
    out = (cells_df.groupBy(*index).pivot(column, list(values) if values else None)
           .agg(F.first("_cell")))
    cells = [c for c in out.columns if c not in index]
    if value is not None and fn.lower() not in ("sum", "count") and cells:
        keep = None
        for c in cells:
            e = F.col(f"`{c}`").isNotNull()
            keep = e if keep is None else keep | e
        out = out.filter(keep)
    return out.na.fill(0, subset=cells) if cells else out


def _pivot_values(df: DataFrame, column: str) -> list:
    """The distinct values of ``column`` in order, from that column alone (the cells need not
    be computed to know them); more than ``spark.sql.pivotMaxValues`` raise."""
    most = int(df.sparkSession.conf.get("spark.sql.pivotMaxValues"))
    got = [r[0] for r in df.select(column).distinct().limit(most + 1).collect()]
    if len(got) > most:
        raise ValueError(f"{column!r} has more than {most} distinct values; pass values")
    return sorted(got)


def cross_tab(df: DataFrame, a: str, b: str, values: Sequence | None = None,
              totals: bool = True, total_label: str = "Total") -> DataFrame:
    """A5: count table of ``a`` x ``b`` with a ``Total`` column and row.

    Counts come from one ``cube(a, b)`` aggregation (partial/final around one
    shuffle); the small result (|a| x |b| cells) is then pivoted."""
    require(df, [a, b])
    base = _keys_not_null(df, [a, b])
    if not totals:
        return pivot_table(base, a, b, values=values)
    cube = base.cube(a, b).agg(F.count(F.lit(1)).alias("_n"),
                               F.grouping(a).alias("_ga"), F.grouping(b).alias("_gb"))
    lab_a = F.when(F.col("_ga") == 1, F.lit(total_label)).otherwise(F.col(a).cast("string"))
    lab_b = F.when(F.col("_gb") == 1, F.lit(total_label)).otherwise(F.col(b).cast("string"))
    cube = cube.select(lab_a.alias(a), lab_b.alias("_b"), "_n")
    if values is None:
        values = _pivot_values(base.select(F.col(b).cast("string").alias(b)), b)
    pv = [str(v) for v in values] + [total_label]
    out = cube.groupBy(a).pivot("_b", pv).agg(F.first("_n"))
    cells = [c for c in out.columns if c != a]
    return out.na.fill(0, subset=cells)


STAT_NAMES = ("Count", "Mean", "Std", "Min", "25%", "50%", "75%", "Max")


def summary_stats(df: DataFrame, cols: Sequence[str] | None = None,
                  approx: bool = False) -> DataFrame:
    """One row per numeric column: Column, Count, Mean, Std, Min, 25%, 50%, 75%,
    Max (pandas ``describe``; quartiles interpolate linearly). Count, moments and
    extremes of every column come from ONE aggregation pass (its one-row result is
    turned into rows with ``inline``). Exact quartiles of all columns come from ONE
    distributed rank selection over the values in long form (column name as the
    group), so no column's values sit in one buffer; ``approx=True`` computes
    sketches inside the single aggregation instead."""
    cols = [c for c in (cols or df.columns) if is_numeric(df, c)]
    require(df, cols)
    if not cols:
        raise ValueError("no numeric columns")
    aggs = []
    for i, c in enumerate(cols):
        x = not_nan(df, c).cast("double")
        fields = [F.lit(c).alias("Column"), F.count(x).alias("Count"), F.avg(x).alias("Mean"),
                  F.stddev_samp(x).alias("Std"), F.min(x).alias("Min")]
        if approx:
            q = F.percentile_approx(x, [0.25, 0.5, 0.75], 10000)
            fields += [F.get(q, 0).alias("25%"), F.get(q, 1).alias("50%"), F.get(q, 2).alias("75%")]
        fields.append(F.max(x).alias("Max"))
        aggs.append(F.struct(*fields).alias(f"s{i}"))
    one = df.agg(*aggs)
    stats = one.select(F.inline(F.array(*[F.col(f"s{i}") for i in range(len(cols))])))
    if approx:
        return stats
    long = None  # one single-column projection per column: each scan reads one column
    for c in cols:
        part = df.select(F.lit(c).alias("_col"), not_nan(df, c).cast("double").alias("_v"))
        long = part if long is None else long.unionByName(part)
    q = exact_quantiles(long, "_v", [0.25, 0.5, 0.75], by=["_col"])
    out = stats.join(q, stats["Column"] == q["_col"], "left")
    return out.select("Column", "Count", "Mean", "Std", "Min", F.col("q0").alias("25%"),
                      F.col("q1").alias("50%"), F.col("q2").alias("75%"), "Max")


#: Parts that the details of one group are spread over.
SUBTOTAL_PARTS = 32


def subtotals(df: DataFrame, key: str, order_by: Sequence[str] | None = None,
              flag: str = "_is_subtotal", label: str = " - SUBTOTAL") -> DataFrame:
    """Detail rows of each group followed by a subtotal row ``<g> - SUBTOTAL``
    holding the sums of all numeric columns (other columns NULL, ``flag`` true).

    With ``order_by`` (the row order), groups appear in order of first appearance
    and details in row order, as the reference lists them; without it, in key order.
    Decisions: NULL keys are dropped (the reference raises), the key is cast to text
    so numeric keys get labels too. Subtotals are one ``groupBy`` (partial
    aggregation) unioned with the detail rows; the first position of each group is
    taken in the same aggregation; then one sort."""
    require(df, [key])
    order_by = as_list(order_by)
    nums = numeric_columns(df, exclude=[key])
    base = df.filter(not_nan(df, key).isNotNull()).withColumn("_g", F.col(key).cast("string"))
    sums = base.groupBy("_g").agg(
        *[F.coalesce(F.sum(not_nan(df, c)), F.lit(0)).cast(
            "long" if _integral(df, c) else "double").alias(c) for c in nums],
        *([F.min(F.struct(*[F.col(o) for o in order_by])).alias("_first")] if order_by else []))
    detail = base.withColumns({key: F.col("_g"), flag: F.lit(False)})
    if order_by:
        # a salt spreads a hot group's details; each of its parts meets a copy of the one row
        parts = F.array(*[F.lit(i) for i in range(SUBTOTAL_PARTS)])
        firsts = sums.select(F.col("_g").alias("_g2"), "_first", F.explode(parts).alias("_p2"))
        salt = F.pmod(F.xxhash64(*[F.col(o) for o in order_by]), F.lit(SUBTOTAL_PARTS)).cast("int")
        detail = detail.withColumn("_p", salt).join(
            firsts, (F.col("_g") == F.col("_g2")) & (F.col("_p") == F.col("_p2"))).drop("_g2", "_p", "_p2")
    sub = sums.withColumns({key: F.concat(F.col("_g"), F.lit(label)), flag: F.lit(True)})
    out = detail.unionByName(sub, allowMissingColumns=True)
    order = ([F.col("_first").asc()] if order_by else []) + [F.col("_g").asc(), F.col(flag).asc()]
    order += [F.col(c).asc_nulls_last() for c in order_by]
    cols = [c for c in df.columns] + [flag]
    return out.orderBy(*order).select(*cols)


def value_counts(df: DataFrame, c: str, out: str = "Count") -> DataFrame:
    """Frequency of each value (NULL and NaN dropped), most frequent first (ties by
    value)."""
    require(df, [c])
    return (df.filter(not_nan(df, c).isNotNull()).groupBy(c).agg(F.count(F.lit(1)).alias(out))
            .orderBy(F.col(out).desc(), F.col(c).asc()))


def column_stat(df: DataFrame, cols: str | Sequence[str], fn: str = "mean",
                approx: bool = False) -> DataFrame:
    """One whole-column statistic per column, as one row (global aggregate)."""
    cols = as_list(cols)
    require(df, cols)
    return aggregate(df, [], [(c, fn, c) for c in cols], approx)


def rollup_totals(df: DataFrame, keys: Sequence[str], cols: Sequence[str],
                  fn: str = "sum", level: str = "level", approx: bool = False) -> DataFrame:
    """A10: aggregates per full key, per key prefix (subtotals) and overall (grand
    total). ``level`` is the ``grouping_id``: 0 for detail rows, larger for coarser
    totals. One ``rollup`` (Expand + partial/final aggregation) computes all levels;
    an exact ``median`` instead aggregates each level with ``aggregate`` (distributed
    rank selection, no per-group value buffer) and unions the levels."""
    keys, cols = as_list(keys), as_list(cols)
    require(df, keys + cols)
    f = check_fn(fn)
    if f != "median" or approx:
        return df.rollup(*keys).agg(*[agg_expr(df, c, fn, approx).alias(c) for c in cols],
                                    F.grouping_id(*keys).alias(level))
    n = len(keys)
    out = None
    for m in range(n, -1, -1):  # keep the first m keys
        part = aggregate(df, keys[:m], [(c, "median", c) for c in cols])
        part = part.select(*[F.col(k) if i < m else F.lit(None).cast(df.schema[k].dataType).alias(k)
                             for i, k in enumerate(keys)], *cols,
                           F.lit((1 << (n - m)) - 1).cast("long").alias(level))
        out = part if out is None else out.unionByName(part)
    return out
