"""URL filters [native]: host-suffix x path-prefix expressions joined with a rule list.

A rule is a host and a path; it fits its host and all subdomains where the url's path
starts with the rule's path. Each distinct (host, path) is expanded into every suffix of its
host at a label border times every prefix of its path that ends in a slash, plus the empty
prefix. A rule's own expression is its host and its path up to the last slash. The two
sides meet by an equi-join on the first 32 bits of the expression's digest; then the full
digest and the rest of the rule's path are confirmed, and the longest rule wins.

Expansions deeper than the deepest rule cannot meet any, so they are not made: their number
for a url is bounded by the rules' labels times slashes, however long the url is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tableops.llm.common import pick

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
URL_PARTS = r"://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty
    for NULL and for a url without ``://``."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), URL_PARTS, 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """From the host's end up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), URL_PARTS, 2)


def _digest(host: Column, path: Column) -> Column:
    return F.md5(F.concat_ws("\n", host, path))


def _short(digest: Column) -> Column:
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def _stem(path: Column) -> Column:
    """The path up to its last slash."""
    return F.regexp_extract(path, r"(?s)^(.*/)", 1)


def _labels(host: Column) -> Column:
    return F.size(F.split(host, r"\."))


def _slashes(path: Column) -> Column:
    return F.length(path) - F.length(F.translate(path, "/", ""))


def prepared_rules(rules: DataFrame) -> DataFrame:
    """``host``, ``path``, ``verdict`` with their expression's digests; a rule stated twice
    counts once, and a block beats an allow of the same host and path. Rules with a NULL
    fit nothing."""
    r = pick(rules, _rhost="host", _rpath="path", _verdict="verdict").dropna() \
        .withColumn("_rhost", F.translate("_rhost", UPPER, LOWER))
    r = r.groupBy("_rhost", "_rpath").agg(F.max("_verdict").alias("_verdict"))
    d = _digest(F.col("_rhost"), _stem(F.col("_rpath")))
    return r.withColumn("_rdigest", d).withColumn("_rshort", _short(F.col("_rdigest")))


def _expressions(urls: DataFrame, deepest: DataFrame) -> DataFrame:
    """``urls`` (host, path), a row for each expression no deeper than the rules."""
    labels, parts = F.split("host", r"\."), F.split("path", "/")
    n = F.size("_labels")
    suffixes = F.transform(F.sequence(F.lit(1), F.least(n, F.col("_most_labels"))), lambda k: F.array_join(
        F.slice("_labels", n - k + 1, k), "."))
    depth = F.least(_slashes(F.col("path")), F.col("_most_slashes"))
    prefixes = F.transform(F.sequence(F.lit(0), depth), lambda k: F.when(k == 0, F.lit("")).otherwise(
        F.concat(F.array_join(F.slice("_parts", F.lit(1), k), "/"), F.lit("/"))))
    deep = [deepest.select(c).scalar().alias(c) for c in ("_most_labels", "_most_slashes")]
    return urls.select("host", "path", labels.alias("_labels"), parts.alias("_parts"), *deep) \
        .select("host", "path", F.explode(suffixes).alias("_suffix"), prefixes.alias("_prefixes")) \
        .select("host", "path", "_suffix", F.explode("_prefixes").alias("_prefix")) \
        .select("host", "path", _digest(F.col("_suffix"), F.col("_prefix")).alias("_digest"))


def filter_urls(pages: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url",
                default: str = "allow") -> DataFrame:
    """One row per row of ``pages``: ``key``, ``host``, ``path``, ``rule`` (host and path of
    the longest rule that fits, host and path counted together, the smaller text at a tie;
    else NULL) and ``verdict`` (the rule's, else ``default``).

    A NULL url and one without ``://`` have an empty host and path, which only a rule of
    empty host and path fits. Repeated rows and NULL keys are judged like others; without
    rules every url gets the default."""
    base = pick(pages, _key=key, _url=url).select("_key", host_of(F.col("_url")).alias("host"),
                                                  path_of(F.col("_url")).alias("path"))
    ready = prepared_rules(rules)
    deepest = ready.agg(F.coalesce(F.max(_labels(F.col("_rhost"))), F.lit(1)).alias("_most_labels"),
                        F.coalesce(F.max(_slashes(F.col("_rpath"))), F.lit(0)).alias("_most_slashes"))
    met = _expressions(base.select("host", "path").distinct(), deepest) \
        .withColumn("_short", _short(F.col("_digest"))) \
        .join(ready, F.col("_short") == F.col("_rshort")) \
        .filter((F.col("_digest") == F.col("_rdigest")) & F.col("path").startswith(F.col("_rpath")))
    rule = F.concat("_rhost", "_rpath")
    best = met.groupBy("host", "path").agg(
        F.min(F.struct((-F.length(rule)).alias("_long"), rule.alias("rule"), "_verdict")).alias("_best")) \
        .select(F.col("host").alias("_h"), F.col("path").alias("_p"), "_best.rule", "_best._verdict")
    return base.join(best, (F.col("host") == F.col("_h")) & (F.col("path") == F.col("_p")), "left").select(
        F.col("_key").alias(key), "host", "path", "rule",
        F.coalesce("_verdict", F.lit(default)).alias("verdict"))
