"""Quality rules [native]: a threshold table compiled into one projection.

``RULES`` is the table: a measure, the least and the greatest accepted value. Every measure
is a column expression over the text alone, so the verdict needs no shuffle, no join and no
user function; it is a filter that Spark evaluates while it scans.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tableops.llm.common import SPACE, let, pick, whole_text

SYMBOLS = "#*$%&|<>"
#: Frequent function words of the four languages of the corpus (fixed values).
STOP_WORDS = ("the of and to in a is that it on for was with as be by at are this from "
              "de la le les et des en un une que est pour dans der die das und ist von zu "
              "den mit ein el los las y del se por con para").split()

#: (measure, least, greatest); None: unbounded.
RULES: Sequence[tuple[str, float | None, float | None]] = (
    ("n_words", 50, None),
    ("mean_word_length", 2, 15),
    ("symbol_ratio", None, 0.1),
    ("stop_word_ratio", 0.02, None),
    ("dup_line_ratio", None, 0.5),
    ("repeat_word_ratio", None, 0.5),
)


def _without(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def _covered(words: Column) -> Column:
    """Words inside a three-word window that occurs more than once. The windows are hashed
    and sorted with their place, equal neighbours are the repeated ones, and their sorted
    places are summed as a union of three-word intervals: n log n in the text's words."""
    def places(s: Column) -> Column:
        def same(x, y):
            return F.coalesce(x["h"] == y["h"], F.lit(False))
        hit = F.filter(s, lambda x, i: same(x, F.get(s, i - 1)) | same(x, F.get(s, i + 1)))
        return F.sort_array(F.transform(hit, lambda x: x["i"]))

    def union(p: Column) -> Column:
        steps = F.transform(p, lambda x, k: F.least(F.lit(3), x - F.coalesce(F.get(p, k - 1), x - 3)))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

    def windows(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.struct(
            F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i")))

    return F.when(F.size(words) < 4, F.lit(0).cast("long")).otherwise(
        let(words, lambda w: let(F.sort_array(windows(w)), lambda s: let(places(s), union))))


def measures(text: Column) -> dict[str, Column]:
    """Counts of one text, in the order in which ``quality_rules`` projects them."""
    trimmed = F.btrim(text, F.lit(SPACE))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(
        F.split(trimmed, r"[\x20\x09-\x0D]+"))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != "")
    return {"_words": words, "_lines": lines,
            "word_chars": F.length(_without(text, SPACE)).cast("long"),
            "n_symbols": (F.length(text) - F.length(_without(text, SYMBOLS))).cast("long")}


def verdict(rules: Sequence[tuple[str, float | None, float | None]] = RULES) -> Column:
    """True where every rule holds. A ratio of nothing is NULL and breaks no rule."""
    ratio = {
        "n_words": F.col("n_words"),
        "mean_word_length": F.try_divide("word_chars", "n_words"),
        "symbol_ratio": F.try_divide("n_symbols", "word_chars"),
        "stop_word_ratio": F.try_divide("n_stop_words", "n_words"),
        "dup_line_ratio": F.try_divide("n_dup_lines", "n_lines"),
        "repeat_word_ratio": F.try_divide("n_repeat_words", "n_words"),
    }
    ok = F.lit(True)
    for name, low, high in rules:
        if low is not None:
            ok = ok & F.coalesce(ratio[name] >= low, F.lit(True))
        if high is not None:
            ok = ok & F.coalesce(ratio[name] <= high, F.lit(True))
    return ok


def _judged(df: DataFrame, text: str, rules) -> DataFrame:
    """``df`` plus the counts and ``kept``; ``text`` must be a string without NULL."""
    m = measures(F.col(text))
    stop = F.array(*[F.lit(w) for w in STOP_WORDS])
    out = df.withColumns(m).withColumns({
        "n_words": F.size("_words").cast("long"),
        "n_lines": F.size("_lines").cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "n_stop_words": F.size(F.filter("_words", lambda w: F.array_contains(stop, F.lower(w)))).cast("long"),
        "n_repeat_words": _covered(F.col("_words")),
    }).drop("_words", "_lines")
    return out.withColumn("base_failed", (F.col("n_words") < 50)
                          | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))) \
        .withColumn("kept", ~F.col("base_failed") & verdict(rules))


def quality_rules(df: DataFrame, key: str = "doc_id", text: str = "text", rules=RULES) -> DataFrame:
    """One row per row of ``df``: ``key``, the counts, ``base_failed`` and ``kept``.

    Words are runs of characters other than space, tab, LF, VT, FF and CR. NULL text counts
    as empty; an empty text has no words and fails. A row with a NULL key is judged like any
    other, repeated rows give repeated results, an empty table an empty result."""
    base = pick(df, _key=key, _text=text).withColumn("_text", whole_text("_text"))
    out = _judged(base, "_text", rules)
    return out.select(F.col("_key").alias(key), "n_words", "word_chars", "n_symbols", "n_dup_lines",
                      "n_repeat_words", "n_stop_words", "n_lines", "base_failed", "kept")


def keep_good(df: DataFrame, text: str = "text", rules=RULES) -> DataFrame:
    """The rows of ``df`` that pass, with their columns as they were."""
    whole = df.select(F.struct(*[df[c] for c in df.columns]).alias("_row"),
                      whole_text(df[text]).alias("_text"))
    # the explode of one element keeps the filter, and with it every measure, in one place
    judged = _judged(whole, "_text", rules).select("_row", F.explode(F.array("kept")).alias("_pass"))
    return judged.filter("_pass").select("_row.*")
