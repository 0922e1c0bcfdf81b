"""Row filters with typed arguments (the reference's ``column op value``
mini-language is replaced by ``(column, op, value)``). Comparisons stay plain
attribute-vs-literal predicates so Catalyst pushes them into the Parquet scan."""

from __future__ import annotations

import math
from collections.abc import Sequence
from decimal import Decimal, InvalidOperation

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tableops.functions.exprs import dtype, is_numeric, require

_ORDERED = {">=": "__ge__", "<=": "__le__", ">": "__gt__", "<": "__lt__"}
OPS = (">=", "<=", "!=", "==", ">", "<", "contains", "startswith", "endswith")


def _quote(s: str) -> str:
    return "\\Q" + s.replace("\\E", "\\E\\\\E\\Q") + "\\E"


_LONG = (-(1 << 63), (1 << 63) - 1)


def _compared(df: DataFrame, c: str, op: str, value) -> Column:
    """``c op value`` for a numeric column, the literal in the column's own type: exact for
    large integers and decimals, and pushed into the scan. A fractional bound on an integer
    column becomes the next integer on its side."""
    x, dt = F.col(c), dtype(df, c)
    if isinstance(dt, T.BooleanType):
        x, dt = x.cast("int"), T.IntegerType()
    if isinstance(dt, (T.FloatType, T.DoubleType)):
        y = F.lit(float(value))
        cond = x == y if op in ("==", "!=") else getattr(x, _ORDERED[op])(y)
        return cond & ~F.isnan(x)
    try:
        v = value if isinstance(value, (int, Decimal)) else Decimal(str(value))
    except InvalidOperation:
        raise ValueError(f"{value!r} is not a number") from None
    if isinstance(v, Decimal) and not v.is_finite():
        below = v.is_infinite() and v < 0
        return x.isNotNull() & F.lit({">": below, ">=": below}.get(op, not below) if not v.is_nan() and op in _ORDERED else False)
    if isinstance(dt, T.DecimalType):
        y = F.lit(Decimal(v))
        return x == y if op in ("==", "!=") else getattr(x, _ORDERED[op])(y)
    whole = int(v) if v == int(v) else None
    if op in ("==", "!="):
        return x == F.lit(whole) if whole is not None and _LONG[0] <= whole <= _LONG[1] else x.isNotNull() & F.lit(False)
    if whole is None:
        up = op in (">=", "<")
        whole = math.ceil(v) if up else math.floor(v)
    if not _LONG[0] <= whole <= _LONG[1]:
        return x.isNotNull() & F.lit((whole < 0) == (op in (">", ">=")))
    return getattr(x, _ORDERED[op])(F.lit(whole))


def filter_rows(df: DataFrame, c: str, op: str, value) -> DataFrame:
    """Keep rows where ``c op value``.

    - ``>= <= > <`` (F1): numeric columns only (decision: text raises up front
      instead of being skipped); NULL and NaN are false.
    - ``==`` (F2): the value is typed by the column: a number for numeric columns,
      text otherwise; text that is not a number never equals a numeric cell.
    - ``!=`` (F3): keeps NULL cells (pandas ``!=``), via NOT null-safe equality.
    - ``contains`` (F4): case-insensitive regular expression; NULL is false.
    - ``startswith`` / ``endswith`` (F5): case-sensitive literal; NULL is false.
    """
    require(df, [c])
    x = F.col(c)
    if op in _ORDERED:
        if not is_numeric(df, c):
            raise ValueError(f"{op} needs a numeric column; {c!r} is not numeric")
        return df.filter(_compared(df, c, op, value))
    if op in ("==", "!="):
        if is_numeric(df, c):
            try:
                float(value)
            except (TypeError, ValueError):
                # text never equals a number: == keeps nothing, != keeps every row
                return df.filter(F.lit(op == "!="))
            equal = _compared(df, c, op, value)
        else:
            equal = x == F.lit(str(value))
        return df.filter(equal if op == "==" else ~F.coalesce(equal, F.lit(False)))
    s = x.cast("string")
    if op == "contains":
        return df.filter(s.rlike("(?i)" + str(value)))
    if op == "startswith":
        return df.filter(s.startswith(str(value)))
    if op == "endswith":
        return df.filter(s.endswith(str(value)))
    raise ValueError(f"unknown operator {op!r}; expected one of {OPS}")


def filter_any_token(df: DataFrame, c: str, terms: Sequence[str]) -> DataFrame:
    """keep rows whose text contains any of ``terms`` (case-insensitive literal
    match; one regular expression with the terms quoted)."""
    require(df, [c])
    if not terms:
        return df.limit(0)
    pattern = "(?i)(" + "|".join(_quote(t) for t in terms) + ")"
    return df.filter(F.col(c).cast("string").rlike(pattern))


def search_rows(df: DataFrame, term: str, cols: Sequence[str] | None = None) -> DataFrame:
    """keep rows where ``term`` occurs (case-insensitive, literal) in the text
    form of any column."""
    cols = list(cols or df.columns)
    require(df, cols)
    t = F.lit(term.lower())
    cond = None
    for c in cols:
        e = F.coalesce(F.lower(F.col(c).cast("string")).contains(t), F.lit(False))
        cond = e if cond is None else cond | e
    return df.filter(cond)
