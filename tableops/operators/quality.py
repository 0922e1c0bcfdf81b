"""V1-V7: validation rules evaluated as violation reports.

The reference attaches spreadsheet input rules to cells and never evaluates them.
Here a rule is a named failure predicate over one column; ``violations`` lists the
failing cells ``(rule, column, row_key, value)`` and ``quality_report`` summarises
``(rule, column, checked, failed)``. Blank cells pass every rule except ``blank``.

All row-local rules are evaluated in ONE pass: each row emits an array of the
rules it fails (``filter`` + ``inline``), and the summary is ONE aggregation.
The ``unique`` rule needs the value counts: a partial/final ``groupBy`` and a
semi join back, never a window holding a hot value's rows in one task.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tableops.functions.exprs import as_list, is_string, not_nan, null_safe_eq, number_in, require


@dataclass(frozen=True)
class Rule:
    name: str          # dropdown, range_check, text_length, blank_check, data_type, no_duplicates
    column: str
    args: tuple = ()

    def fails(self, df: DataFrame) -> Column:
        c = not_nan(df, self.column)
        present = c.isNotNull()
        if is_string(df, self.column):
            present = present & (F.trim(c) != "")
        if self.name == "dropdown":
            (vals,) = self.args
            return present & ~c.cast("string").isin(list(vals))
        if self.name == "range_check":
            lo, hi = self.args
            x = c if not is_string(df, self.column) else number_in(c)
            bad = x.isNull()
            if lo is not None:
                bad = bad | (x < F.lit(lo))
            if hi is not None:
                bad = bad | (x > F.lit(hi))
            return present & bad
        if self.name == "text_length":
            (n,) = self.args
            return present & (F.length(c.cast("string")) > F.lit(n))
        if self.name == "blank_check":
            return ~present
        if self.name == "data_type":
            (t,) = self.args
            return present & F.expr(f"try_cast(`{self.column}` as {t})").isNull()
        raise ValueError(f"rule {self.name!r} is not row-local")


def allowed(column: str, values: str | Sequence[str]) -> Rule:
    """V1 dropdown: value must be one of ``values`` (a list, or text split on , or ;)."""
    if isinstance(values, str):
        values = [v.strip() for v in values.replace(";", ",").split(",") if v.strip()]
    return Rule("dropdown", column, (tuple(str(v) for v in values),))


def in_range(column: str, lo: float | None = None, hi: float | None = None) -> Rule:
    """V2 range_check: inclusive ``lo <= x <= hi``; either bound may be omitted. Text
    that is not a number fails."""
    if lo is None and hi is None:
        raise ValueError("give lo, hi or both")
    return Rule("range_check", column, (lo, hi))


def max_length(column: str, n: int) -> Rule:
    """V3 text_length: length of the text form <= ``n``."""
    return Rule("text_length", column, (int(n),))


def blank(column: str) -> Rule:
    """V5 blank_check: NULL or empty/blank text fails."""
    return Rule("blank_check", column)


def of_type(column: str, type: str) -> Rule:
    """V6 data_type: text that does not cast to ``type`` (Spark SQL type name) fails."""
    return Rule("data_type", column, (type,))


def unique(columns: str | Sequence[str]) -> Rule:
    """V4 no_duplicates: every row whose value (combination) occurs more than once."""
    cols = tuple(as_list(columns))
    return Rule("no_duplicates", ",".join(cols), cols)


def _row_key(key: str | Sequence[str] | None) -> Column:
    keys = as_list(key)
    if not keys:
        return F.lit(None).cast("string")
    return F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys])


def _dup_rows(df: DataFrame, rule: Rule, key) -> DataFrame:
    cols = list(rule.args)
    require(df, cols)
    nn = None
    for c in cols:  # blank cells pass, as in every rule but blank_check
        e = F.col(c).isNotNull()
        if is_string(df, c):
            e = e & (F.trim(F.col(c)) != "")
        nn = e if nn is None else nn & e
    base = df.filter(nn)
    dups = base.groupBy(*[F.col(c).alias(f"_d{i}") for i, c in enumerate(cols)]).count() \
               .filter(F.col("count") > 1).drop("count")
    hit = base.join(dups, null_safe_eq([F.col(c) for c in cols],
                                       [F.col(f"_d{i}") for i in range(len(cols))]), "left_semi")
    value = F.concat_ws("|", *[F.col(c).cast("string") for c in cols])
    return hit.select(F.lit(rule.name).alias("rule"), F.lit(rule.column).alias("column"),
                      _row_key(key).alias("row_key"), value.alias("value"))


def violations(df: DataFrame, rules: Sequence[Rule], key: str | Sequence[str] | None = None) -> DataFrame:
    """Failing cells of every rule: ``rule, column, row_key, value`` (value as text)."""
    if not rules:
        raise ValueError("give at least one rule")
    local = [r for r in rules if r.name != "no_duplicates"]
    parts = []
    if local:
        require(df, [r.column for r in local])
        arr = F.array(*[
            F.when(r.fails(df), F.struct(F.lit(r.name).alias("rule"), F.lit(r.column).alias("column"),
                                         F.col(r.column).cast("string").alias("value")))
            for r in local])
        parts.append(df.select(_row_key(key).alias("row_key"),
                               F.filter(arr, lambda x: x.isNotNull()).alias("_f"))
                     .select("row_key", F.inline("_f"))
                     .select("rule", "column", "row_key", "value"))
    for r in rules:
        if r.name == "no_duplicates":
            parts.append(_dup_rows(df, r, key))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def quality_report(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """V7 error_detection: ``rule, column, checked, failed`` for every rule; row-local
    rules in one aggregation pass. ``checked`` counts the rows examined."""
    if not rules:
        raise ValueError("give at least one rule")
    local = [r for r in rules if r.name != "no_duplicates"]
    out = None
    if local:
        require(df, [r.column for r in local])
        one = df.agg(F.count(F.lit(1)).alias("_rows"), *[
            F.count_if(r.fails(df)).alias(f"_r{i}") for i, r in enumerate(local)])
        arr = F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(r.column).alias("column"),
                                 F.col("_rows").alias("checked"), F.col(f"_r{i}").alias("failed"))
                        for i, r in enumerate(local)])
        out = one.select(F.inline(arr))
    for r in rules:
        if r.name != "no_duplicates":
            continue
        dup = _dup_rows(df, r, None)
        part = df.agg(F.count(F.lit(1)).alias("checked")).select(
            F.lit(r.name).alias("rule"), F.lit(r.column).alias("column"), "checked",
            dup.select(F.count(F.lit(1))).scalar().alias("failed"))
        out = part if out is None else out.unionByName(part)
    return out


# Single-rule shortcuts (V1-V6) -----------------------------------------------------

def check_allowed(df, c, values, key=None):
    return violations(df, [allowed(c, values)], key)


def check_range(df, c, lo=None, hi=None, key=None):
    return violations(df, [in_range(c, lo, hi)], key)


def check_length(df, c, n, key=None):
    return violations(df, [max_length(c, n)], key)


def check_unique(df, cols, key=None):
    return violations(df, [unique(cols)], key)


def check_blank(df, cols, key=None):
    return violations(df, [blank(c) for c in as_list(cols)], key)


def check_type(df, c, type, key=None):
    return violations(df, [of_type(c, type)], key)
