"""The queries of this package's operators, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm import audio, langid, mixing, neardup, packing, quality, tokens, urls, vectors, warc
from larkspur.llm.common import crc_of_id, prepare

#: Shingle words of the near-duplicate query.
DEDUP_WORDS = 4
URL_RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{table}.parquet")


def _fold(of: int, which: int) -> Column:
    """Whether a document is in the fold; a null doc_id is in none, and teaches nothing."""
    return F.coalesce(crc_of_id() % of == which, F.lit(False))


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels")
    model = quality.train(docs, labels.where(crc_of_id() % 4 != 2))
    return quality.classify(docs, model).withColumn("held_out", _fold(4, 2))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    profiles = langid.train(docs.where(crc_of_id() % 5 != 0))
    return langid.identify(docs, profiles).withColumn("held_out", _fold(5, 0))


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(_read(spark, sf_dir, "embeddings"))


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_read(spark, sf_dir, "documents"))


def op5_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_read(spark, sf_dir, "documents"), words=DEDUP_WORDS)


def op6_warc_convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = warc.archive(_read(spark, sf_dir, "pages"))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(_read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(_read(spark, sf_dir, "pages"), URL_RULES)


def op10_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audio.store_and_probe(_read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_quality_classifier,
        op2_language_id,
        op3_embedding_dedup,
        op4_source_mixing,
        op5_minhash_dedup,
        op6_warc_convert,
        op7_packing,
        op8_token_counts,
        op9_url_filter,
        op10_mpeg_audio,
    )
}

_OP4 = r"""
WITH sized AS (
  SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents),
totals AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT source, source_size, 2.0::DOUBLE * source_size AS cap,
         CAST(CASE k % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS DOUBLE) AS w,
         CAST(CASE k % 3 WHEN 0 THEN 0.5 WHEN 1 THEN -0.5 ELSE 0 END AS DOUBLE) AS slope
  FROM (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS k FROM totals)),
lines AS (
  SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) * 1.5::DOUBLE
             - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS line
  FROM weighed),
goals AS (SELECT source, source_size, slope, least(w * max(line) OVER (), cap) AS target FROM lines),
run AS (
  SELECT s.doc_id, s.size, g.source_size, g.slope, g.target, CAST(floor(g.target + 0.5) AS BIGINT) AS quota,
         CAST(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.h, s.doc_id, s.size ROWS UNBOUNDED PRECEDING) - s.size AS BIGINT) AS "at"
  FROM sized s JOIN goals g ON s.source IS NOT DISTINCT FROM g.source),
passes AS (
  SELECT *, CAST(greatest(0, least(size, quota - "at")) AS BIGINT) AS t0,
            CAST(greatest(0, least(size, quota - source_size - "at")) AS BIGINT) AS t1,
            CAST("at" AS DOUBLE) / nullif(target, 0) AS f0, CAST(source_size + "at" AS DOUBLE) / nullif(target, 0) AS f1
  FROM run),
timed AS (
  SELECT *, CASE WHEN slope = 0 THEN f0 ELSE (sqrt((1 - slope) * (1 - slope) + 4.0::DOUBLE * slope * f0) - (1 - slope)) / (2.0::DOUBLE * slope) END AS p0,
            CASE WHEN t1 = 0 THEN NULL WHEN slope = 0 THEN f1 ELSE (sqrt((1 - slope) * (1 - slope) + 4.0::DOUBLE * slope * f1) - (1 - slope)) / (2.0::DOUBLE * slope) END AS p1
  FROM passes)
SELECT doc_id, size, source_size, target, CAST(t0 + t1 AS BIGINT) AS taken,
       CASE WHEN t0 > 0 THEN round(abs(p0), 9) END AS position, CASE WHEN t1 > 0 THEN round(abs(p1), 9) END AS again
FROM timed
"""

_OP6 = """
WITH payloads AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
digests AS (
  SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, max(page_id) OVER (PARTITION BY html) AS last,
         array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           1 + CAST((CAST('0x' || substr(hex, 1 + 5 * (i // 4), 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31 AS BIGINT), 1)), '') AS payload_digest
  FROM payloads)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN last > page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN last > page_id THEN last END AS refers_to
FROM digests
"""

_OP9 = r"""
WITH rests AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT page_id, translate(regexp_extract(rest, '(?s)^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '(?s)^[^/?#]*([^?#]*)', 1) AS path
  FROM rests),
rules(rhost, rpath, rverdict) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
fits AS (
  SELECT page_id, host, path, rhost || rpath AS rule, rverdict,
         row_number() OVER (PARTITION BY page_id ORDER BY length(rhost || rpath) DESC NULLS LAST) AS k
  FROM parts LEFT JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT page_id, host, path, rule, coalesce(rverdict, 'allow') AS verdict FROM fits WHERE k = 1
"""

_OP3 = """
WITH RECURSIVE good AS (
  SELECT vec_id, v FROM (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings)
  WHERE vec_id IS NOT NULL AND v IS NOT NULL AND len(v) > 0
    AND len(list_filter(v, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))) >= 0.9),
reach(id, other) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.id, l.b FROM reach r JOIN links l ON l.a = r.other),
least AS (SELECT id, min(other) AS component_id FROM reach GROUP BY id)
SELECT e.vec_id, (SELECT count(*) FROM links l WHERE l.a = e.vec_id) AS n_links, component_id, e.vec_id = component_id AS kept
FROM embeddings e JOIN least ON least.id = e.vec_id
"""

_OP5 = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS s FROM words),
flat AS (SELECT doc_id, len(s) AS n, unnest(s) AS v FROM sets),
held AS (SELECT doc_id, n, v FROM flat JOIN (SELECT v FROM flat GROUP BY v HAVING count(*) > 1) USING (v)),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM held a JOIN held b ON a.v = b.v AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reach(id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.id, l.b FROM reach r JOIN links l ON l.a = r.other),
least AS (SELECT id, min(other) AS component_id FROM reach GROUP BY id)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM sets JOIN least ON id = doc_id
"""

ORACLES: dict[str, str] = {"op3_embedding_dedup": _OP3, "op5_minhash_dedup": _OP5, "op4_source_mixing": _OP4, "op6_warc_convert": _OP6, "op9_url_filter": _OP9}
