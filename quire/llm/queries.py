"""The registered query of each training-data operator, with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quire.llm import decontaminate, exact_dedup, html_extract, language_id, mixing, packing, ppm, simhash, token_count, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str = "piece_bpe_32k.model") -> str:
    """Path of a public vocabulary file, which every executor has at the same place."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(_table(spark, sf_dir, "pages"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(_table(spark, sf_dir, "documents"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_dedup(_table(spark, sf_dir, "documents"), shingle=3, radius=2)


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.score_texts(_table(spark, sf_dir, "documents"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.token_counts(_table(spark, sf_dir, "documents"), tokenizer_file(), limit=4096)


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_table(spark, sf_dir, "documents"))


def op10_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), tokenizer_file(), length=2048)


OP3_SQL = r"""
WITH sizes AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')) AS key FROM documents
), by_source AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sizes GROUP BY source
), ranked AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM by_source
), limited AS (
  SELECT *, CASE rank % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight, source_size * 2.0::DOUBLE AS most FROM ranked
), filled AS (
  SELECT *, most / weight AS level,
    (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(most) OVER w, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0)) AS own_level
  FROM limited WINDOW w AS (ORDER BY most / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), water AS (
  SELECT first(own_level ORDER BY level, rank) AS height FROM filled WHERE own_level <= level
), targets AS (
  SELECT source, source_size, rank, least(most, coalesce(height * weight, most)) AS target FROM filled LEFT JOIN water ON true
), placed AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, t.rank, CAST(round(t.target) AS BIGINT) AS goal,
    CAST(coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key, s.doc_id, s.size
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
  FROM sizes s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
), taken AS (
  SELECT *, greatest(0, least(size, goal - start)) AS once, greatest(0, least(size, goal - start - source_size)) AS twice,
    least(1.0::DOUBLE, start / greatest(target, 1.0::DOUBLE)) AS share
  FROM placed
)
SELECT doc_id, size, source_size, target, CAST(once + twice AS BIGINT) AS taken,
  CASE WHEN once > 0 THEN round(CASE rank % 3
    WHEN 0 THEN share
    WHEN 1 THEN CASE WHEN share <= 0.625 THEN (1.5 - sqrt(greatest(0, 2.25 - 2 * share))) / 1.0 ELSE 0.5 + (1.0 - sqrt(greatest(0, 1.0 - 2 * (share - 0.625)))) END
    ELSE CASE WHEN share <= 0.375 THEN sqrt(greatest(0, 0.25 + 2 * share)) - 0.5 ELSE 0.5 + sqrt(greatest(0, 1.0 + 2 * (share - 0.375))) - 1.0 END
  END, 9) END AS position
FROM taken
"""

OP6_SQL = """
WITH rows AS (
  SELECT page_id, coalesce(html, '') AS html, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS last FROM pages
), bits AS (
  SELECT *, list_transform(range(8), lambda i: CAST('0x' || substr(sha1(html), 5 * i + 1, 5) AS BIGINT)) AS parts FROM rows
)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
  list_aggregate(list_transform(parts, lambda v: concat(
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (v >> 15), 1), substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((v >> 10) & 31), 1),
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((v >> 5) & 31), 1), substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (v & 31), 1))), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id IS NOT DISTINCT FROM last THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM last THEN last END AS refers_to
FROM bits
"""

OP9_SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
  doc_id IS NOT DISTINCT FROM max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_html_extraction, op2_language_id, op3_mixing, op4_simhash, op5_lm_scoring, op6_warc, op7_decontamination, op8_token_counts, op9_exact_dedup, op10_token_ids]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op3_mixing": OP3_SQL, "op6_warc": OP6_SQL, "op9_exact_dedup": OP9_SQL}
