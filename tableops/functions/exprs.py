"""Small column helpers: type tests, null-safe equality, total orders."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType,
           T.DoubleType, T.DecimalType)
FLOATING = (T.FloatType, T.DoubleType)
TEMPORAL = (T.DateType, T.TimestampType, T.TimestampNTZType)


def as_col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def as_list(x) -> list:
    if x is None:
        return []
    if isinstance(x, (str, Column)):
        return [x]
    return list(x)


def dtype(df: DataFrame, name: str) -> T.DataType:
    try:
        return df.schema[name].dataType
    except KeyError:
        raise KeyError(f"column {name!r} not in {df.columns}") from None


def require(df: DataFrame, cols: Iterable[str]) -> None:
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise KeyError(f"columns {missing} not in {df.columns}")


def is_numeric(df: DataFrame, name: str) -> bool:
    return isinstance(dtype(df, name), NUMERIC + (T.BooleanType,))


def is_floating(df: DataFrame, name: str) -> bool:
    return isinstance(dtype(df, name), FLOATING)


def is_string(df: DataFrame, name: str) -> bool:
    return isinstance(dtype(df, name), T.StringType)


def kind(dt: T.DataType) -> str:
    """Coarse kind used by the profiler: numeric / bool / date / text / other."""
    if isinstance(dt, T.BooleanType):
        return "bool"
    if isinstance(dt, NUMERIC):
        return "numeric"
    if isinstance(dt, TEMPORAL):
        return "date"
    if isinstance(dt, T.StringType):
        return "text"
    return "other"


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, NUMERIC) and f.name not in exclude]


def not_nan(df: DataFrame, name: str) -> Column:
    """Null-aware value: NaN in a float column reads as NULL (pandas semantics)."""
    c = F.col(name)
    if is_floating(df, name):
        return F.nanvl(c, F.lit(None).cast(dtype(df, name)))
    return c


#: Text that reads as a number (thousands commas already removed).
NUMBER_TEXT = r"(?i)^[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?|inf|infinity)$"


def number_in(text: Column) -> Column:
    """The number that a text holds, as double; NULL for any other text (Spark's own cast
    also reads Java literals such as ``5D``)."""
    t = F.trim(text)
    return F.when(t.rlike(NUMBER_TEXT), t.try_cast("double"))


def null_safe_eq(left: Sequence[Column], right: Sequence[Column]) -> Column:
    cond = None
    for a, b in zip(left, right):
        e = a.eqNullSafe(b)
        cond = e if cond is None else cond & e
    return cond


def orderable(dt: T.DataType) -> bool:
    if isinstance(dt, T.MapType) or dt.typeName() == "variant":
        return False
    if isinstance(dt, T.ArrayType):
        return orderable(dt.elementType)
    if isinstance(dt, T.StructType):
        return all(orderable(f.dataType) for f in dt.fields)
    return True


def total_order(df: DataFrame, order_by: Sequence[str | Column] | None = None,
                exclude: Sequence[str] = ()) -> list[Column]:
    """Sort expressions: the caller's order first, then every other orderable column
    ascending as a tie-breaker, so keep-first / last-wins choices are deterministic.
    Rows equal on all columns are interchangeable, so the order is total in effect."""
    out: list[Column] = []
    named: set[str] = set(exclude)
    for o in as_list(order_by):
        if isinstance(o, str):
            named.add(o)
            out.append(F.col(o).asc_nulls_last())
        else:
            out.append(o)
    for f in df.schema.fields:
        if f.name not in named and orderable(f.dataType):
            out.append(F.col(f.name).asc_nulls_last())
    return out
