"""The queries opN_<name> over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, crf, media, mixing, packing, quality_rules, secret_scan, simhash, suffix_dedup, token_counts
from .shared import new_path, stored

MULTI = "byte_bpe_multi_50k.tiktoken"
RANKS = "byte_bpe_50k.tiktoken"
JSON = "byte_bpe_50k.json"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stores every text as a PNG column, reads it back and computes its features."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    stored = media.to_media(docs).withColumn("n_bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"))
    return media.media_features(stored, keep=("doc_id", "n_bytes"))


def op2_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fits the field on labels that aren't held out and scores every document."""
    docs = documents(spark, sf_dir)
    return crf.scored(docs, crf.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op3_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scans every blob once through a new ledger and joins the findings back to all documents."""
    return secret_scan.digests(secret_scan.scan(documents(spark, sf_dir)))


def op4_packed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the ids of all documents in packed files and reads the files back."""
    manifest = packing.write_files(documents(spark, sf_dir), new_path(spark, "packed"), public_tokenizers.path(JSON), 50257, 2)
    return packing.read_files(spark, manifest)


def op5_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts, base verdict and the weakly supervised verdict of every document."""
    found = quality_rules.judged(documents(spark, sf_dir))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "good_probability")


def op6_water_filling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document."""
    return mixing.mix(documents(spark, sf_dir))


def op7_length_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and truncated totals for every encoded length as a context limit."""
    histogram = token_counts.length_histogram(documents(spark, sf_dir), public_tokenizers.path(RANKS))
    return token_counts.running_sums(stored(histogram, "histogram"))


def op8_prefix_doubling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Removes every 400-byte string that occurs more than once from every document, and counts the words in repeated passages of over 50 words."""
    return suffix_dedup.removed(documents(spark, sf_dir), passages=True)


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes every text, decodes it again, and returns digests of both."""
    return bpe.round_trip(documents(spark, sf_dir), public_tokenizers.path(MULTI))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    found = simhash.near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", simhash.hex_fingerprint().alias("fingerprint"), "component_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_media_columns, op2_line_crf, op3_secret_ledger, op4_packed_ids, op5_weak_supervision, op6_water_filling, op7_length_histogram, op8_prefix_doubling, op9_byte_bpe, op10_simhash)}

# ---------------------------------------------------------------- SQL

_KINDS = [
    ("assign", 6, r"""(?:(?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", 1),
    ("access", 20, "AKIA[A-Z0-9]+", 0),
    ("hex", 24, "[0-9a-f]+", 0),
    ("forge", 0, "gh[pousr]_[A-Za-z0-9]{36,}", 0),
    ("pem", 0, "-----BEGIN [A-Z ]*PRIVATE KEY-----", 0),
]
_FOUND = " UNION ALL ".join(
    f"SELECT doc_id, {rank} AS rank, '{kind}' AS kind, {least} AS least, string_split_regex(t, '{p}') AS between_, regexp_extract_all(t, '{p}', 0) AS whole, regexp_extract_all(t, '{p}', {group}) AS part FROM docs"
    for rank, (kind, least, p, group) in enumerate(_KINDS)
)

ORACLES: dict[str, str] = {
    "op3_secret_ledger": f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
found AS ({_FOUND}),
each AS (SELECT *, unnest(range(1, len(whole) + 1)) AS k FROM found),
placed AS (
  SELECT doc_id, rank, kind, list_sum(list_transform(between_[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(whole[1:k - 1], lambda x: length(x))), 0) AS a, length(whole[k]) AS n FROM each WHERE length(part[k]) >= least),
per AS (
  SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
         string_agg(kind || ':' || CAST(a AS BIGINT) || ':' || CAST(a + n AS BIGINT), ',' ORDER BY a, rank) FILTER (rank < 3) AS base, string_agg(kind || ':' || CAST(a AS BIGINT) || ':' || CAST(a + n AS BIGINT), ',' ORDER BY a, rank) AS spans
  FROM placed GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs LEFT JOIN per USING (doc_id)
""",
    "op8_prefix_doubling": """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
p AS (SELECT doc_id, n, base, substr(h, CAST(2 * base + 1 AS BIGINT), 2800) AS h FROM (SELECT doc_id, n, h, unnest(range(0, n - 399, 1000)) AS base FROM d)),
w AS (SELECT doc_id, i, md5_number(substr(h, CAST(2 * (i - base) + 1 AS BIGINT), 800)) AS k FROM (SELECT doc_id, h, base, unnest(range(base, least(base + 1000, n - 399))) AS i FROM p)),
c AS (SELECT k FROM w GROUP BY k HAVING count(*) > 1),
s AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 400 THEN 0 ELSE 1 END AS fresh FROM w SEMI JOIN c USING (k)),
r AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM s),
runs AS (SELECT doc_id, run, min(i) AS a, max(i) + 400 AS b FROM r GROUP BY doc_id, run),
holes AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM runs),
kept AS (SELECT doc_id, string_agg(substr(h, CAST(2 * before + 1 AS BIGINT), CAST(2 * (a - before) AS BIGINT)), '' ORDER BY a) || substr(any_value(h), CAST(2 * max(b) + 1 AS BIGINT)) AS k, sum(b - a) AS n_removed, count(*) AS n_spans FROM holes JOIN d USING (doc_id) GROUP BY doc_id),
words AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS l FROM documents),
pw AS (SELECT doc_id, i, md5_number(array_to_string(l[i:i + 50], ' ')) AS k FROM (SELECT doc_id, l, unnest(range(1, len(l) - 49)) AS i FROM words)),
pc AS (SELECT k FROM pw GROUP BY k HAVING count(*) > 1),
passages AS (SELECT doc_id, sum(least(51, coalesce(following - i, 51))) AS n FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS following FROM pw SEMI JOIN pc USING (k)) GROUP BY doc_id)
SELECT doc_id, d.n AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(k, h))) AS kept_sha256,
       CAST(d.n - coalesce(n_removed, 0) AS BIGINT) AS n_kept, CAST(coalesce(passages.n, 0) AS BIGINT) AS n_passage_words, passages.n IS NOT NULL AS has_passage
FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN passages USING (doc_id)
""",
}
