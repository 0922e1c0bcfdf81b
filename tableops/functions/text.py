"""Text-cell normalisation expressions.

The reference normalises cells by turning line breaks into spaces, collapsing runs
of blanks and trimming (``' '.join(s.split())``). Python's ``split()`` also splits on
Unicode spaces (U+00A0, U+2000-U+200A, U+3000, ...) and the separators U+001C-U+001F;
Java's ``\\h`` (horizontal) and ``\\v`` (vertical whitespace) cover the former and
run as fast as the ASCII ``\\s`` class, unlike a long explicit list of ranges.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tableops.functions.exprs import as_col

# Whitespace run: what Python's str.split() treats as blank.
WS = "[\\h\\v\\x1c-\\x1f]+"


def squash(c: str | Column) -> Column:
    """Collapse every whitespace run to one space and trim; NULL stays NULL."""
    return F.trim(F.regexp_replace(as_col(c).cast("string"), WS, " "))


def normalized(c: str | Column) -> Column:
    """``squash`` with NULL read as empty text (the reference's cell normaliser)."""
    return F.coalesce(squash(c), F.lit(""))


def words(c: str | Column) -> Column:
    """Whitespace tokens of a text; NULL or blank text gives NULL (pandas split)."""
    return F.split(F.nullif(squash(c), F.lit("")), " ")


def tokens(c: str | Column) -> Column:
    """Whitespace tokens; NULL or blank text gives an empty array."""
    s = normalized(c)
    return F.when(s == "", F.array().cast("array<string>")).otherwise(F.split(s, " "))
