"""Row predicates as Column expressions (all built-ins, no UDF)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tableops.functions.text import normalized


def token_match(term: str | Column, value: str | Column) -> Column:
    """F8: flexible term-to-value match, true when any of these holds on the
    lower-cased, whitespace-normalised texts ``s`` (term) and ``v`` (value):

    1. ``s`` occurs in ``v`` or ``v`` occurs in ``s``;
    2. for some word ``w`` of ``v`` (parentheses count as blanks): ``s`` occurs in
       ``w``, ``w`` occurs in ``s``, or both are at least 3 characters long and share
       their first 3 characters;
    3. some whitespace token of ``s`` occurs inside some token of ``v``.

    Both arguments are column names or Columns (use ``F.lit`` for a fixed term).
    An empty or NULL side never matches (decision: the reference would let a blank
    term match everything).
    """
    s = F.lower(normalized(term))
    v = F.lower(normalized(value))
    vwords = F.filter(F.split(F.translate(v, "()", "  "), " "), lambda w: w != "")
    stoks = F.split(s, " ")
    vtoks = F.split(v, " ")
    s3 = F.substring(s, 1, 3)
    by_word = F.exists(vwords, lambda w: w.contains(s) | s.contains(w)
                       | ((F.length(s) >= 3) & w.startswith(s3))
                       | ((F.length(w) >= 3) & s.startswith(F.substring(w, 1, 3))))
    by_token = F.exists(stoks, lambda a: F.exists(vtoks, lambda b: b.contains(a)))
    return ((s != "") & (v != "")
            & (v.contains(s) | s.contains(v) | by_word | by_token))
