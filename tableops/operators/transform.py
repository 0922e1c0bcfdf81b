"""Projections and column transforms (row-local, no shuffle)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tableops.functions.exprs import (
    as_list, dtype, is_numeric, is_string, number_in, require, NUMERIC,
)
from tableops.functions.text import normalized, words


def select_as(df: DataFrame, mapping: Mapping[str, str] | Sequence[str]) -> DataFrame:
    """Keep some columns, optionally renamed ``{old: new}``."""
    if not isinstance(mapping, Mapping):
        mapping = {c: c for c in mapping}
    require(df, mapping)
    return df.select(*[F.col(o).alias(n) for o, n in mapping.items()])


def add_column(df: DataFrame, names: str | Sequence[str], type: str = "string") -> DataFrame:
    """New all-NULL column(s) of ``type``."""
    return df.withColumns({n: F.lit(None).cast(type) for n in as_list(names)})


def rename_column(df: DataFrame, old: str, new: str) -> DataFrame:
    """Rename one column (decision: an unknown name raises)."""
    require(df, [old])
    return df.withColumnsRenamed({old: new})


def remove_column(df: DataFrame, cols: str | Sequence[str]) -> DataFrame:
    """T4: drop columns; unknown names are ignored."""
    return df.drop(*as_list(cols))


def split_column(df: DataFrame, c: str, outs: Sequence[str], sep: str | None = None) -> DataFrame:
    """T5: split a text column into ``outs``. Default: on whitespace runs, blank text
    gives NULLs; missing parts are NULL and extra parts are dropped. With ``sep`` the
    split is on that literal separator."""
    require(df, [c])
    if sep is None:
        parts = words(c)
    else:
        parts = F.split(F.col(c).cast("string"), _quote(sep))
    return df.withColumns({o: F.get(parts, i) for i, o in enumerate(outs)})


def _quote(s: str) -> str:
    return "\\Q" + s.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def merge_columns(df: DataFrame, cols: Sequence[str], out: str, sep: str = " ",
                  null_text: str = "") -> DataFrame:
    """Join cells as text with ``sep``; NULL prints as ``null_text`` and keeps its
    separator (bare ``concat_ws`` would skip it)."""
    require(df, cols)
    return df.withColumn(out, F.concat_ws(sep, *[
        F.coalesce(F.col(c).cast("string"), F.lit(null_text)) for c in cols]))


def fill_missing(df: DataFrame, value="N/A", cols: Sequence[str] | None = None,
                 cast: bool = False) -> DataFrame:
    """T7 (fill_missing / replace_nan / fillna): fill NULL (and float NaN) cells with
    ``value`` (default ``N/A``, as in the reference).

    Without ``cols``, every column whose type fits ``value`` is filled (numbers fill
    numeric columns, fractions no integer columns, text fills text columns). A named column whose type does not
    fit raises, unless ``cast=True``, which turns it into text explicitly (the
    reference's silent mixed-type column)."""
    targets = as_list(cols) or [
        f.name for f in df.schema.fields if _fits(f.dataType, value)]
    require(df, targets)
    repl = {}
    for c in targets:
        dt = dtype(df, c)
        if _fits(dt, value):
            x = F.col(c)
            if isinstance(dt, (T.FloatType, T.DoubleType)):
                x = F.nanvl(x, F.lit(None).cast(dt))
            repl[c] = F.coalesce(x, F.lit(value).cast(dt))
        elif cast:
            repl[c] = F.coalesce(F.col(c).cast("string"), F.lit(str(value)))
        else:
            raise TypeError(f"fill value {value!r} does not fit column {c!r} ({dt.simpleString()})")
    return df.withColumns(repl)


def _fits(dt: T.DataType, value) -> bool:
    if isinstance(value, bool):
        return isinstance(dt, T.BooleanType)
    if isinstance(value, (int, float)):
        fractional = isinstance(value, float) and value != int(value) if value == value and abs(value) != float("inf") else True
        return isinstance(dt, NUMERIC) and not (fractional and isinstance(
            dt, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)))
    if isinstance(value, str):
        return isinstance(dt, T.StringType)
    return False


def replace_values(df: DataFrame, old, new, cols: Sequence[str] | None = None) -> DataFrame:
    """Replace whole cells equal to ``old`` by ``new``. Text never matches a
    number (``'5'`` leaves the number 5 alone), as in pandas."""
    targets = as_list(cols) or [f.name for f in df.schema.fields if _fits(f.dataType, old)]
    require(df, targets)
    repl = {}
    for c in targets:
        dt = dtype(df, c)
        if not _fits(dt, old):
            continue
        if not _fits(dt, new) and new is not None:
            raise TypeError(f"replacement {new!r} does not fit column {c!r} ({dt.simpleString()})")
        repl[c] = F.when(F.col(c) == F.lit(old), F.lit(new).cast(dt)).otherwise(F.col(c))
    return df.withColumns(repl) if repl else df


def to_numeric(df: DataFrame, cols: str | Sequence[str]) -> DataFrame:
    """Coerce to double; thousands commas removed, bad text becomes NULL."""
    cols = as_list(cols)
    require(df, cols)
    return df.withColumns({c: F.col(c) if is_numeric(df, c) and not is_string(df, c) else
                           number_in(F.regexp_replace(F.col(c), ",", ""))
                           for c in cols})


def normalize_text(df: DataFrame, cols: str | Sequence[str]) -> DataFrame:
    """Line breaks to spaces, blank runs collapsed, trimmed; NULL becomes ''."""
    cols = as_list(cols)
    require(df, cols)
    return df.withColumns({c: normalized(c) for c in cols})


def drop_missing(df: DataFrame, cols: str | Sequence[str] | None = None) -> DataFrame:
    """Drop rows with a NULL in any of ``cols`` (all columns by default)."""
    return df.na.drop(how="any", subset=as_list(cols) or None)


def bin_values(df: DataFrame, c: str, edges: Sequence[float], labels: Sequence[str] | None,
               out: str) -> DataFrame:
    """Right-closed bins ``(e[i], e[i+1]]`` (the lowest edge itself is outside,
    like ``pd.cut``); values outside every bin and NULL give NULL. Labels default to
    ``(a, b]`` text."""
    require(df, [c])
    if len(edges) < 2:
        raise ValueError("need at least two edges")
    if labels is None:
        labels = [f"({a}, {b}]" for a, b in zip(edges, edges[1:])]
    if len(labels) != len(edges) - 1:
        raise ValueError("labels must be one fewer than edges")
    x = F.col(c)
    e = None
    for (a, b), lab in zip(zip(edges, edges[1:]), labels):
        cond = (x > F.lit(a)) & (x <= F.lit(b))
        e = F.when(cond, F.lit(lab)) if e is None else e.when(cond, F.lit(lab))
    return df.withColumn(out, e)


def number_format(df: DataFrame, c: str, style: str = "number", digits: int = 2,
                  out: str | None = None, symbol: str = "$") -> DataFrame:
    """Numbers as display text: ``number`` (1,234.50), ``currency`` ($1,234.50,
    minus sign before the symbol) or ``percent`` (value x 100, 12.50%)."""
    require(df, [c])
    x = F.col(c).cast("double")
    if style == "number":
        e = F.format_number(x, digits)
    elif style == "currency":
        e = F.when(x < 0, F.concat(F.lit("-" + symbol), F.format_number(-x, digits))) \
             .otherwise(F.concat(F.lit(symbol), F.format_number(x, digits)))
    elif style == "percent":
        e = F.concat(F.format_number(x * 100, digits), F.lit("%"))
    else:
        raise ValueError(f"unknown style {style!r}")
    return df.withColumn(out or c, e)
