"""Registered queries of the corpus operators, with SQL where SQL expresses them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tableops.catalog.common import Registry, table
from tableops.llm.bpe import ids_digest, recode_texts
from tableops.llm.common import let, whole_text
from tableops.llm.decontam import find_leaks
from tableops.llm.divergence import source_divergence
from tableops.llm.lines import line_dedup
from tableops.llm.near import near_dedup
from tableops.llm.periodic import periodic_runs
from tableops.llm.quality import STOP_WORDS, quality_rules
from tableops.llm.secrets import BASE_RULES, find_secrets
from tableops.llm.shards import shard_rows
from tableops.llm.spans import repeated_spans
from tableops.llm.toxicity import toxicity
from tableops.llm.urls import filter_urls
from tableops.llm.warc import audit, lay_out, record_text
from tableops.plans.lineage import cut_lineage

R = Registry()

#: The rule list of the URL query (fixed values): verdict, host, path.
URL_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
             ("block", "net", "/es/"), ("block", "net", "/fr/")]


def _joined(spans):
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


#: Records of an archive in the audit query, by page id.
ARCHIVE_PAGES = 4096

AUDIT_SQL = """
WITH r AS (SELECT page_id AS key, coalesce('crawl-' || (page_id // 4096), '') AS archive,
    'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Record-ID: '
    || coalesce(page_id::VARCHAR, '') || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10)
    || 'Content-Length: ' || strlen(coalesce(html, '')) || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '')
    || chr(13) || chr(10) || chr(13) || chr(10) AS record FROM pages),
d AS (SELECT key, archive, strlen(record) AS length, sha256(record) AS digest, record FROM r),
o AS (SELECT *, coalesce(sum(length) OVER (PARTITION BY archive ORDER BY digest, key
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset" FROM d)
SELECT key AS page_id, archive, "offset", CASE WHEN key % 101 = 7 THEN 'missing' ELSE 'changed' END AS state,
       digest AS left_digest, CASE WHEN key % 101 <> 7 THEN sha256('~' || substr(record, 2)) END AS right_digest
FROM o WHERE key % 101 = 7 OR key % 89 = 11"""


@R.add("op1_warc_fixity", AUDIT_SQL)
def op1_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audits the archives of all pages against a replica that lost a record where page_id
    modulo 101 is 7 and has another first byte where page_id modulo 89 is 11."""
    pages = table(spark, sf_dir, "pages")
    record = record_text(F.col("page_id"), F.col("url"), F.col("html"))
    rows = pages.select(F.col("page_id").alias("key"), record.alias("record"), F.coalesce(
        F.concat(F.lit("crawl-"), F.floor(F.col("page_id") / ARCHIVE_PAGES)), F.lit("")).alias("archive"))
    rot = F.concat(F.lit("~"), F.substring("record", 2, 2 ** 31 - 1))
    digests = rows.select("key", "archive", F.octet_length("record").cast("long").alias("length"),
                          F.sha2("record", 256).alias("digest"), F.sha2(rot, 256).alias("rotten"))
    left = lay_out(digests.select("archive", F.struct("key", "rotten").alias("key"), "length", "digest")) \
        .select("archive", "offset", "length", "digest", F.col("key.key").alias("page_id"), F.col("key.rotten").alias("rotten"))
    left = cut_lineage(left)
    hit = F.coalesce(F.col("page_id") % 89 == 11, F.lit(False))
    right = left.filter(F.coalesce(F.col("page_id") % 101 != 7, F.lit(True))) \
        .withColumn("digest", F.when(hit, F.col("rotten")).otherwise(F.col("digest")))
    names = left.select(F.col("archive").alias("_a"), F.col("offset").alias("_o"), "page_id")
    found = audit(left, right)
    return found.join(names, (F.col("archive") == F.col("_a")) & (F.col("offset") == F.col("_o"))).select(
        "page_id", "archive", "offset", "state", "left_digest", "right_digest")


@R.add("op2_benchmark_decontamination")
def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@R.add("op3_secret_scans")
def op3_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = [r.kind for r in BASE_RULES]
    found = find_secrets(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda x: x["kind"].isin(kinds))

    def count(kind: str):
        return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *[count(k) for k in kinds],
                        F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


@R.add("op4_bpe_encoding")
def op4_bpe_encoding(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    path = path or public_tokenizers.path("word_bpe_49k.json")
    out = recode_texts(table(spark, sf_dir, "documents"), path)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), ids_digest(F.col("ids")).alias("ids_sha256"),
                      F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


@R.add("op5_line_dedup")
def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(table(spark, sf_dir, "documents"))


@R.add("op6_url_filters", r"""
WITH rules(verdict, host, path) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'),
       ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
p AS (SELECT page_id,
        translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)([^?#]*)', 1),
                  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(coalesce(url, ''), '://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
u AS (SELECT DISTINCT host, path FROM p),
best AS (SELECT u.host, u.path, arg_max(r.host || r.path, length(r.host || r.path)) AS rule,
        arg_max(r.verdict, length(r.host || r.path)) AS verdict
      FROM u JOIN rules r ON (u.host = r.host OR ends_with(u.host, '.' || r.host)) AND starts_with(u.path, r.path)
      GROUP BY u.host, u.path)
SELECT page_id, p.host, p.path, rule, coalesce(verdict, 'allow') AS verdict
FROM p LEFT JOIN best ON p.host = best.host AND p.path = best.path""")
def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "verdict string, host string, path string")
    return filter_urls(table(spark, sf_dir, "pages"), rules)


QUALITY_SQL = r"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS MATERIALIZED (SELECT *, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
       list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
tri AS (SELECT rid, unnest(range(1, greatest(len(ws) - 1, 1))) AS i, ws FROM w),
same AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, ws[i], ws[i + 1], ws[i + 2]) AS n FROM tri),
rep AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM same WHERE n > 1)
        GROUP BY rid),
m AS (SELECT doc_id, len(ws) AS n_words,
        length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
        length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
        len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words,
        len(list_filter(ws, lambda x: list_contains([{stop}], lower(x)))) AS n_stop_words, len(ls) AS n_lines
      FROM w LEFT JOIN rep USING (rid)),
v AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT *, NOT base_failed AND coalesce(n_words >= 50, true)
  AND coalesce(word_chars::DOUBLE / nullif(n_words, 0) BETWEEN 2 AND 15, true)
  AND coalesce(n_symbols::DOUBLE / nullif(word_chars, 0) <= 0.1::DOUBLE, true)
  AND coalesce(n_stop_words::DOUBLE / nullif(n_words, 0) >= 0.02::DOUBLE, true)
  AND coalesce(n_dup_lines::DOUBLE / nullif(n_lines, 0) <= 0.5::DOUBLE, true)
  AND coalesce(n_repeat_words::DOUBLE / nullif(n_words, 0) <= 0.5::DOUBLE, true) AS kept
FROM v""".replace("{stop}", ", ".join(f"'{w}'" for w in STOP_WORDS))


@R.add("op7_minhash_near_dedup")
def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents"))


@R.add("op8_quality_rules", QUALITY_SQL)
def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


@R.add("op9_substring_dedup")
def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_spans(table(spark, sf_dir, "documents"))


@R.add("op10_sharding")
def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_rows(table(spark, sf_dir, "documents"))


def _planted(key: Column, text: Column) -> Column:
    """The text, of every tenth key (by its checksum) with a periodic end of its own words: from
    word a on, word i becomes word a + (i - a) modulo p. A NULL key counts as the empty text."""
    h = F.crc32(F.coalesce(key.cast("string"), F.lit("")))
    g = F.floor(h / 10)

    def ended(words: Column) -> Column:
        n = F.size(words)
        a = (g % n).cast("int")
        return let(F.struct(a.alias("a"), (1 + F.floor((n - a) / (3 + g % 8))).cast("int").alias("p")), lambda x: F.array_join(
            F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(words, F.when(i < x["a"], i).otherwise(
                x["a"] + (i - x["a"]) % x["p"]))), " "))

    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    return F.when(h % 10 == 0, let(words, lambda w: F.when(F.size(w) > 0, ended(w)).otherwise(F.lit("")))).otherwise(text)


@R.add("op11_periodic_runs")
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    docs = docs.select("doc_id", _planted(F.col("doc_id"), whole_text("text")).alias("text"))
    runs = periodic_runs(docs)
    rows = F.array_join(F.transform("runs", lambda r: F.concat(
        r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    top = F.col("strongest")
    return runs.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), top["start"].alias("start"), top["length"].alias("length"),
        top["period"].alias("period"), F.call_function("div", top["length"] * 1000, top["period"]).alias("exponent_milli"),
        F.sha2(rows.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.encode("collapsed", "UTF-8"), 256).alias("collapsed_sha256"))


@R.add("op12_toxicity")
def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


DIVERGENCE_SQL = r"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                       '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
t AS MATERIALIZED (SELECT rid, lang, source, unnest(terms) AS term FROM d),
kept AS MATERIALIZED (SELECT lang, term, count(*) AS n FROM t GROUP BY lang, term HAVING count(DISTINCT rid) >= 10),
langs AS MATERIALIZED (SELECT lang, count(*) AS v, sum(n)::BIGINT AS total FROM kept GROUP BY lang),
c AS MATERIALIZED (SELECT t.lang, t.source, t.term, count(*) AS n FROM t JOIN kept ON t.lang = kept.lang AND t.term = kept.term
      GROUP BY t.lang, t.source, t.term),
g AS MATERIALIZED (SELECT g.lang, g.source, coalesce(s.total, 0)::BIGINT AS total
      FROM (SELECT DISTINCT lang, source FROM d) g LEFT JOIN (SELECT lang, source, sum(n)::BIGINT AS total FROM c GROUP BY lang, source) s
        ON g.lang = s.lang AND g.source = s.source),
p AS MATERIALIZED (SELECT g.lang, g.source, kept.term, coalesce(c.n, 0)::BIGINT AS n,
        1 + (1000000000 * (coalesce(c.n, 0) + 2)) // (g.total + 2 * langs.v) AS p,
        1 + (1000000000 * (kept.n + 2)) // (langs.total + 2 * langs.v) AS q
      FROM g JOIN langs ON g.lang = langs.lang JOIN kept ON kept.lang = g.lang
      LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p))::BIGINT AS value
      FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
part AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(pairs.value, 0)::BIGINT AS value
      FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
      LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source
    UNION ALL SELECT lang, source, 'term', term, (((p - q) * (p - q)) // (p + q))::BIGINT FROM p WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM part)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 10"""


@R.add("op13_source_divergence", DIVERGENCE_SQL)
def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(table(spark, sf_dir, "documents"))
