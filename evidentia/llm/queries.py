"""The queries of this package, by the names under which the driver runs them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from evidentia.llm import ann, bpe, langid, licenses, mixing, neardup, phrases, toxicity, url_filter, warc
from evidentia.llm.common import session

#: Host, path and verdict of the URL rules.
URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return session(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), rules)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_documents(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.fit(docs))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.fingerprint_documents(table(spark, sf_dir, "documents"))


def fingerprint_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the fingerprints those columns that SQL can make: lengths and edited texts."""
    return op5_fingerprints(spark, sf_dir).select("doc_id", "n_chars", "edited_sha256")


def op6_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"))


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), percent=85)


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.encode_documents(table(spark, sf_dir, "documents"), vocabulary, public_tokenizers.PATTERN)


def byte_bpe_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the encoding the column that SQL can make: what the ids decode to is the text."""
    return op8_byte_bpe(spark, sf_dir).select("doc_id", "decoded_sha256")


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_documents(table(spark, sf_dir, "documents"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


URL_SQL = r"""
WITH p AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages
), r(h, q, v) AS (VALUES
""" + ",\n".join(f"  ('{h}', '{q}', '{v}')" for h, q, v in URL_RULES) + r"""
)
SELECT page_id, host, path, arg_max(h || q, length(h || q)) AS rule,
       coalesce(arg_max(v, length(h || q)), 'allow') AS verdict,
       arg_max(sha256(h || chr(10) || q), length(h || q)) AS digest
FROM p LEFT JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, q)
GROUP BY page_id, host, path
"""

#: All queries against all vectors; the least distances in the order of components, as the operator sums them.
NEAREST_SQL = """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE len(list_filter(embedding, lambda x: x <> 0)) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
d AS (SELECT q.vec_id AS query_id, v.vec_id,
  sqrt(list_reduce(list_transform(list_zip(q.e, v.e), lambda z: (z[1] - z[2]) * (z[1] - z[2])), lambda t, x: t + x, CAST(0 AS DOUBLE))) AS score FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS INTEGER) AS rank, vec_id, score FROM d
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) <= 10
"""

#: Links by an exact join on shingles, and components by reachability.
NEAR_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, hash(unnest(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(list_slice(w, i, i + 4), ' ')) END))) AS g FROM w),
n AS (SELECT w.doc_id, count(s.g) AS n FROM w LEFT JOIN s ON w.doc_id = s.doc_id GROUP BY w.doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT p.a, p.b FROM p JOIN n x ON p.a = x.doc_id JOIN n y ON p.b = y.doc_id WHERE 100 * c >= 85 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS id, doc_id AS far FROM n UNION SELECT r.id, e.b FROM r JOIN e ON r.far = e.a)
SELECT n.doc_id, n.n AS n_shingles, min(far) AS component_id, min(far) = n.doc_id AS kept FROM n JOIN r ON n.doc_id = r.id GROUP BY n.doc_id, n.n
"""

EDITS_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), o AS (SELECT *, coalesce(lead(t) OVER (ORDER BY doc_id), first_value(t) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS u FROM d)
SELECT doc_id, length(t) AS n_chars, sha256(substr(t, 1, length(t) - length(t) // 4) || substr(u, 1, length(t) // 4)) AS edited_sha256 FROM o
"""

QUERIES = {
    "op1_url_filter": op1_url_filter,
    "op2_toxicity": op2_toxicity,
    "op3_mixing": op3_mixing,
    "op4_language_id": op4_language_id,
    "op5_fingerprints": op5_fingerprints,
    "op6_nearest_neighbours": op6_nearest_neighbours,
    "op7_near_duplicates": op7_near_duplicates,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_license_scan": op9_license_scan,
    "op10_warc": op10_warc,
    "fingerprint_edits": fingerprint_edits,
    "byte_bpe_decoded": byte_bpe_decoded,
}

ORACLE = {
    "op1_url_filter": URL_SQL,
    "op3_mixing": mixing.ORACLE,
    "op6_nearest_neighbours": NEAREST_SQL,
    "op7_near_duplicates": NEAR_SQL,
    "op10_warc": warc.ORACLE,
    "fingerprint_edits": EDITS_SQL,
    "byte_bpe_decoded": "SELECT doc_id, sha256(coalesce(text, '')) AS decoded_sha256 FROM documents",
}
