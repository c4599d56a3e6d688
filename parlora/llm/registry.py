"""Queries of the operators over the shared test tables, and SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import exact_dedup, fingerprint, language_id, licenses, mixing, near_dup, pii, piece_codec, quality, substring_dedup

Query = Callable[[SparkSession, str], DataFrame]


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify_languages(_docs(spark, sf_dir))


OP1_SQL = r"""
WITH normal AS (
  SELECT doc_id, lang, string_split(regexp_replace('_' || lower(text) || '_', '[^\p{L}]+', '_', 'g'), '') AS chars
  FROM documents),
letters AS (
  SELECT doc_id, lang, c, lead(c) OVER w AS c2, lead(c, 2) OVER w AS c3
  FROM (SELECT doc_id, lang, unnest(chars) AS c, generate_subscripts(chars, 1) AS i FROM normal)
  WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
grams AS (
  SELECT doc_id, lang, c AS g FROM letters WHERE c <> '_'
  UNION ALL SELECT doc_id, lang, c || c2 FROM letters WHERE c2 IS NOT NULL AND NOT (c = '_' AND c2 = '_')
  UNION ALL SELECT doc_id, lang, c || c2 || c3 FROM letters WHERE c3 IS NOT NULL AND c2 <> '_'),
counts AS (SELECT doc_id, lang, g, count(*) AS n FROM grams GROUP BY ALL),
own AS (
  SELECT doc_id, g, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, g) AS r FROM counts
  QUALIFY r <= 300),
profile AS (
  SELECT lang, g, row_number() OVER (PARTITION BY lang ORDER BY n DESC, g) AS r
  FROM (SELECT lang, g, sum(n) AS n FROM counts WHERE lang <> '' GROUP BY ALL)
  QUALIFY r <= 300),
langs AS (SELECT DISTINCT lang FROM profile),
far AS (
  SELECT o.doc_id, l.lang, sum(CASE WHEN p.r IS NULL THEN 300 ELSE abs(o.r - p.r) END) AS distance, count(*) AS n
  FROM own o CROSS JOIN langs l LEFT JOIN profile p ON p.lang = l.lang AND p.g = o.g
  GROUP BY ALL),
best AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY distance, lang) AS k FROM far QUALIFY k = 1)
SELECT d.doc_id, b.lang AS detected, CAST(coalesce(b.distance, 0) AS BIGINT) AS distance,
       CAST(coalesce(b.n, 0) AS INTEGER) AS n_grams, coalesce(b.distance <= 0.9 * 300 * b.n, false) AS accepted
FROM documents d LEFT JOIN best b ON b.doc_id = d.doc_id
"""


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.ngram_jaccard_links(_docs(spark, sf_dir))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codec.encode(_docs(spark, sf_dir))


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(_docs(spark, sf_dir))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify_quality(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(_docs(spark, sf_dir))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(_docs(spark, sf_dir))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_docs(spark, sf_dir))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_spans(_docs(spark, sf_dir))


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixing_rates(_docs(spark, sf_dir), targets={"src0": 4.0}, default=1.0)


OP8_SQL = """
SELECT min(doc_id) AS doc_id, count(*) - 1 AS copies,
       coalesce(list_sort(list(doc_id) FILTER (WHERE doc_id <> first_id)), []) AS removed
FROM (SELECT doc_id, text, min(doc_id) OVER (PARTITION BY text) AS first_id FROM documents WHERE text IS NOT NULL)
GROUP BY text
UNION ALL
SELECT doc_id, 0 AS copies, CAST([] AS BIGINT[]) AS removed FROM documents WHERE text IS NULL
"""


OP2_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9\x{80}-\x{10ffff}]+') AS w
  FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
grams AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i+2], ' ')) END) AS g
  FROM words WHERE len(w) > 0),
sets AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k
  FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM shared JOIN sets x ON x.doc_id = a JOIN sets y ON y.doc_id = b
  WHERE k / (x.n + y.n - k) >= 0.5),
edges AS (SELECT a AS u, b AS v FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT u, v FROM edges UNION SELECT r.u, e.v FROM reach r JOIN edges e ON e.u = r.v),
classes AS (SELECT u, min(v) AS least FROM reach GROUP BY u),
degrees AS (SELECT u, count(*) AS n FROM edges GROUP BY u)
SELECT d.doc_id, coalesce(c.least, d.doc_id) AS class_id, coalesce(g.n, 0) AS n_links
FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL) d
LEFT JOIN classes c ON c.u = d.doc_id LEFT JOIN degrees g ON g.u = d.doc_id
"""


OP9_SQL = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9\x{80}-\x{10ffff}]+') AS w
  FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
stretches AS (
  SELECT doc_id, i, array_to_string(w[i + 1 : i + 50], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(len(w) - 49)) AS i FROM words WHERE len(w) >= 50)),
shared AS (
  SELECT DISTINCT doc_id, i
  FROM stretches SEMI JOIN (SELECT g FROM stretches GROUP BY g HAVING min(doc_id) < max(doc_id)) USING (g)),
apart AS (SELECT *, coalesce(i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50, true) AS begins FROM shared),
islands AS (SELECT doc_id, i, sum(begins::INT) OVER (PARTITION BY doc_id ORDER BY i) AS island FROM apart)
SELECT doc_id, CAST(min(i) AS INTEGER) AS start_token, CAST(max(i) + 50 AS INTEGER) AS end_token,
       CAST(max(i) + 50 - min(i) AS INTEGER) AS n_tokens
FROM islands GROUP BY doc_id, island
"""


QUERIES = (
    op1_language_id,
    op2_ngram_jaccard_join,
    op3_sentencepiece,
    op4_fingerprints,
    op5_quality_classifier,
    op6_license_scan,
    op7_pii,
    op8_exact_dedup,
    op9_substring_dedup,
    op10_source_mixing,
)


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return {"op1_language_id": OP1_SQL, "op2_ngram_jaccard_join": OP2_SQL, "op8_exact_dedup": OP8_SQL, "op9_substring_dedup": OP9_SQL}
