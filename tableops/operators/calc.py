"""Row-wise calculations across columns (one projection, no shuffle), plus
percentage of a column total (C10) through a one-row scalar subquery."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tableops.functions.exprs import as_list, is_numeric, not_nan, require
from tableops.plans.totals import scalar

FUNCTIONS = ("sum", "mean", "average", "min", "minimum", "max", "maximum", "count",
             "median", "multiply", "divide", "percentage", "variance", "std_dev")


def _values(df: DataFrame, cols: Sequence[str]) -> list[Column]:
    for c in cols:
        if not is_numeric(df, c):
            raise TypeError(f"column {c!r} is not numeric")
    return [not_nan(df, c).cast("double") for c in cols]


def _present(vals: list[Column]) -> Column:
    """Sorted array of the non-NULL values of a row (no lambda: ``array_compact`` and
    ``sort_array`` stay inside whole-stage codegen)."""
    return F.sort_array(F.array_compact(F.array(*vals)))


def _divide(a: Column, b: Column, ieee: bool) -> Column:
    if not ieee:
        return F.try_divide(a, b)
    inf = F.lit(float("inf"))
    return (F.when(b != 0, a / b)
            .when(a > 0, inf).when(a < 0, -inf)
            .when(a.isNotNull() & b.isNotNull(), F.lit(float("nan"))))


def _integral(df: DataFrame, cols: Sequence[str]) -> bool:
    from pyspark.sql import types as T
    return all(isinstance(df.schema[c].dataType, (T.ByteType, T.ShortType, T.IntegerType,
                                                  T.LongType)) for c in cols)


def _row_expr(df: DataFrame, fn: str, cols: Sequence[str], ieee: bool) -> Column:
    if fn in ("sum", "min", "minimum", "max", "maximum", "multiply") and _integral(df, cols):
        # integers stay integers, as in pandas (ANSI mode raises on overflow)
        iv = [F.col(c).cast("long") for c in cols]
        if fn == "sum":
            return reduce(lambda a, b: a + b, [F.coalesce(x, F.lit(0).cast("long")) for x in iv])
        if fn == "multiply":
            return reduce(lambda a, b: a * b, iv)
        if len(iv) == 1:
            return iv[0]
        return F.least(*iv) if fn in ("min", "minimum") else F.greatest(*iv)
    v = _values(df, cols)
    n_present = reduce(lambda a, b: a + b, [x.isNotNull().cast("long") for x in v])
    total = reduce(lambda a, b: a + b, [F.coalesce(x, F.lit(0.0)) for x in v])
    if fn == "sum":
        return total
    if fn in ("mean", "average"):
        return F.try_divide(total, F.nullif(n_present, F.lit(0)).cast("double"))
    if fn in ("min", "minimum"):
        return v[0] if len(v) == 1 else F.least(*v)
    if fn in ("max", "maximum"):
        return v[0] if len(v) == 1 else F.greatest(*v)
    if fn == "count":
        return n_present
    if fn == "median":
        a = _present(v)
        n = F.size(a)
        mid = F.floor(n / 2).cast("int")
        return (F.when(n == 0, F.lit(None).cast("double"))
                .when(n % 2 == 1, F.get(a, mid))
                .otherwise((F.get(a, mid - 1) + F.get(a, mid)) / 2))
    if fn == "multiply":
        return reduce(lambda a, b: a * b, v)
    if fn == "divide":
        if len(v) < 2:
            raise ValueError("divide needs two columns")
        return _divide(v[0], v[1], ieee)
    if fn == "percentage":
        if len(v) < 2:
            raise ValueError("row percentage needs two columns")
        return _divide(v[0], v[1], ieee) * 100
    if fn in ("variance", "std_dev"):
        # two-pass sample variance, unrolled over the columns (plain expressions)
        n = n_present.cast("double")
        mean = total / n
        ss = reduce(lambda a, b: a + b,
                    [F.when(x.isNotNull(), (x - mean) * (x - mean)).otherwise(F.lit(0.0)) for x in v])
        var = F.when(n >= 2, ss / (n - 1))
        return var if fn == "variance" else F.sqrt(var)
    raise ValueError(f"unknown calculation {fn!r}; expected one of {FUNCTIONS}")


def calc(df: DataFrame, fn: str, cols: str | Sequence[str], out: str = "Result",
         ieee: bool = False) -> DataFrame:
    """Add ``out`` = ``fn`` across ``cols`` for every row.

    Null rules follow pandas: sum skips NULL and an all-NULL row sums to 0; mean,
    min, max and median skip NULL (all-NULL gives NULL); count counts non-NULL cells;
    multiply and divide propagate NULL. Division by zero gives NULL (``try_divide``:
    ANSI mode stays on); ``ieee=True`` gives +-inf / NaN like pandas. ``variance`` and
    ``std_dev`` are the sample (n-1) statistics of the row's non-NULL values.

    ``percentage`` with one column is the share of the column total (C10), computed
    as ``x / total * 100`` with the total evaluated once as a scalar subquery.
    """
    cols = as_list(cols)
    require(df, cols)
    fn = fn.lower()
    if fn == "percentage" and len(cols) == 1:
        x = _values(df, cols)[0]
        total = scalar(df, F.sum(x))
        return df.withColumn(out, _divide(x, total, ieee) * 100)
    return df.withColumn(out, _row_expr(df, fn, cols, ieee))
