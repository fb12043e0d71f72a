"""Queries of the training-data operators, each over its whole table, and SQL where it can express one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontam, fingerprints, mixing, quality, sharding, simhash, suffix_dedup, token_codes, toxicity, url_filter
from .cluster import table

#: Hosts of the blocklist that the pages are checked against in production.
BLOCKED = ("casino-win.example.com/", "casino-win.example.net/", "casino-win.example.org/", "free-bets.example.com/", "free-bets.example.net/", "free-bets.example.org/", "cheap-pills.example.com/", "cheap-pills.example.net/", "cheap-pills.example.org/", "ads-track.example.com/", "ads-track.example.net/", "ads-track.example.org/", "adult-x.example.com/", "adult-x.example.net/", "adult-x.example.org/", "spam-farm.example.com/", "spam-farm.example.net/", "spam-farm.example.org/")


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(table(spark, sf_dir, "documents"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shuffle(table(spark, sf_dir, "documents"))


def op3_token_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_codes.encode_documents(table(spark, sf_dir, "documents"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.groups(table(spark, sf_dir, "documents"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = spark.createDataFrame([(u,) for u in BLOCKED], "url string")
    return url_filter.listed_pages(table(spark, sf_dir, "pages"), listed)


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeated_passages(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_fingerprints, op2_sharding, op3_token_codes, op4_mixing, op5_decontamination, op6_toxicity, op7_quality, op8_simhash, op9_url_filter, op10_suffix_dedup)}


#: Words and their whole texts, in DuckDB's dialect.
_OP4 = f"""
WITH d AS (SELECT *, len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\r]+')) AS n, CAST('0x' || substr(md5('{mixing.SEED}:' || doc_id), 1, 8) AS BIGINT) AS key FROM documents WHERE doc_id IS NOT NULL),
t AS (SELECT source, CAST(sum(n) AS BIGINT) AS words, CAST(ceil(sum(n) / {mixing.BLOCK}.0) AS BIGINT) AS blocks FROM d GROUP BY source),
laid AS (SELECT d.*, blocks, coalesce(sum(n) OVER (PARTITION BY source ORDER BY key, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS b FROM d JOIN t USING (source) WHERE words > 0),
cut AS (SELECT *, unnest(range(least(b // {mixing.BLOCK}, blocks - 1), least((b + greatest(n - 1, 0)) // {mixing.BLOCK}, blocks - 1) + 1)) AS block FROM laid),
pieces AS (SELECT *, row_number() OVER (PARTITION BY source, block ORDER BY key, doc_id) - 1 AS place, greatest(block * {mixing.BLOCK} - b, 0) AS start_word, least((block + 1) * {mixing.BLOCK} - b, n) AS end_word FROM cut),
w AS (SELECT source, blocks, CAST(floor(sqrt(CAST(words AS DOUBLE)) * 1000) AS BIGINT) AS w FROM t WHERE words > 0),
c AS (SELECT *, CAST(sum(w) OVER (ORDER BY CAST('0x' || substr(md5('0:' || source), 1, 8) AS BIGINT), source) AS BIGINT) AS hi, CAST(sum(w) OVER () AS BIGINT) AS total FROM w),
bounds AS (SELECT source, blocks, CAST(floor(CAST(hi - w AS DOUBLE) / total * {mixing.RANGE}) AS BIGINT) AS lo, CAST(floor(CAST(hi AS DOUBLE) / total * {mixing.RANGE}) AS BIGINT) AS up FROM c),
slots AS (SELECT slot, ((slot % {mixing.RANGE}) * {mixing.GOLDEN}) % {mixing.RANGE} AS x FROM (SELECT unnest(range((SELECT CAST(sum(blocks) AS BIGINT) FROM bounds))) AS slot)),
placed AS (SELECT slot, source, blocks, row_number() OVER (PARTITION BY source ORDER BY slot) - 1 AS r FROM slots JOIN bounds ON x >= lo AND x < up),
ranked AS (SELECT slot, source, blocks, r % blocks AS nth, r // blocks AS epoch, [{", ".join(map(str, mixing.PRIMES))}] AS primes FROM placed),
plan AS (SELECT slot, source, epoch, CASE WHEN epoch = 0 THEN nth ELSE (nth * (CASE WHEN blocks % primes[epoch % 8 + 1] = 0 THEN primes[(epoch + 1) % 8 + 1] ELSE primes[epoch % 8 + 1] END) + CAST('0x' || substr(md5('{mixing.SEED}:' || epoch), 1, 8) AS BIGINT)) % blocks END AS block FROM ranked)
SELECT slot, source, CAST(block AS BIGINT) AS block, CAST(epoch AS BIGINT) AS epoch, CAST(place AS BIGINT) AS place, doc_id, CAST(start_word AS BIGINT) AS start_word, CAST(end_word AS BIGINT) AS end_word,
  CASE WHEN n = 0 THEN text ELSE array_to_string(list_slice(regexp_extract_all(text, '(?:^[ \\t\\n\\r]*)?[^ \\t\\n\\r]+[ \\t\\n\\r]*'), start_word + 1, end_word), '') END AS text, lang, n_chars
FROM plan JOIN pieces USING (source, block)"""

_OP9 = f"""
WITH l AS (SELECT unnest([{", ".join(repr(u) for u in BLOCKED)}]) AS e),
b AS (SELECT page_id, url, regexp_replace(regexp_replace(lower(trim(url)), '^[a-z][a-z0-9+.-]*://', ''), '[?#].*$', '') AS bare, row_number() OVER () AS r FROM pages),
h AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(regexp_extract(bare, '^[^/]*'), '^.*@', ''), ':[0-9]*$', ''), '^(www\\.|m\\.)+', '') AS host, regexp_replace(regexp_replace(regexp_extract(bare, '/.*$'), '\\.html?$', ''), '^/+|/+$', '', 'g') AS path FROM b),
m AS (SELECT page_id, url, host || '/' || path AS canonical_url, e AS listed_url, row_number() OVER (PARTITION BY r ORDER BY length(e) DESC, e) AS rn FROM h JOIN l ON host || '/' = e OR ends_with('.' || host || '/', '.' || e) WHERE host <> '')
SELECT page_id, url, canonical_url, listed_url FROM m WHERE rn = 1"""

_OP10 = f"""
WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS ws FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
k AS (SELECT doc_id, ws, min(doc_id) OVER (PARTITION BY ws) AS rep FROM w WHERE len(ws) >= {suffix_dedup.LEAST}),
win AS (SELECT doc_id, p, md5(array_to_string(list_slice(ws, p + 1, p + {suffix_dedup.LEAST}), ' ')) AS h FROM (SELECT doc_id, ws, unnest(range(0, len(ws) - {suffix_dedup.LEAST - 1})) AS p FROM k WHERE rep = doc_id)),
f AS (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY h) AS first_doc_id FROM win),
g AS (SELECT *, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id, first_doc_id ORDER BY p) + {suffix_dedup.LEAST} THEN 0 ELSE 1 END AS new FROM f WHERE first_doc_id <> doc_id),
i AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, first_doc_id ORDER BY p) AS part FROM g),
spans AS (SELECT doc_id, min(p) AS start_word, max(p) + {suffix_dedup.LEAST} AS end_word, first_doc_id FROM i GROUP BY doc_id, first_doc_id, part
  UNION ALL SELECT doc_id, 0, len(ws), rep FROM k WHERE rep <> doc_id)
SELECT doc_id, CAST(start_word AS BIGINT) AS start_word, CAST(end_word AS BIGINT) AS end_word, CAST(end_word - start_word AS BIGINT) AS n_words, first_doc_id FROM spans"""


def oracle_sql() -> dict[str, str]:
    """The others fit models, draw at random, or depend on hashes that SQL doesn't have."""
    return {"op4_mixing": _OP4, "op9_url_filter": _OP9, "op10_suffix_dedup": _OP10}
