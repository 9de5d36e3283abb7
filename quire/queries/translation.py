"""Queries over resolution, the cache, backends and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import rules
from quire.functions import text as X
from quire.operators import backends as B
from quire.operators import cache as C
from quire.operators import report as P
from quire.operators import resolve as R
from quire.plans.staging import staged
from quire.plans.translate import text_hash, translate_documents
from quire.queries import query, table
from quire.queries.common import CACHE_SQL, CASED, HASH, LETTERS, ROSTER, TERMS_SQL, cache, cased, glossary
from quire.queries.text import CLASSIFY_SQL, GUARDED_SQL, MARKER_SQL, ORDINAL_SQL, TOKENS_SQL, VERIFIED_SQL

CONTEXT = B.Context(entities=tuple(ROSTER))
_HEADED = r"^(\d{1,2}(?:\.\d{1,2})?\.?)\s+(.*)$"
RESOLVED_SQL = f"""{CASED}, {TERMS_SQL}{CACHE_SQL}, distinct_units AS (SELECT unit, count(*) AS uses FROM cased GROUP BY unit), looked AS (
  SELECT unit, uses, {GUARDED_SQL} AS guarded, coalesce(a.translation, regexp_extract(unit, '{_HEADED}', 1) || ' ' || b.translation) AS hit, c.en AS cached
  FROM distinct_units LEFT JOIN terms a ON a.term = unit
  LEFT JOIN terms b ON regexp_matches(unit, '{_HEADED}') AND b.term = trim(regexp_extract(unit, '{_HEADED}', 2))
  LEFT JOIN cache c ON c.source = unit AND c.status = 'ok'
), resolved AS (
  SELECT unit, uses, CASE WHEN guarded THEN 'protected' WHEN hit IS NOT NULL THEN 'glossary' WHEN cached IS NOT NULL THEN 'cache' ELSE 'backend' END AS via,
    CASE WHEN guarded THEN unit ELSE coalesce(hit, cached) END AS en FROM looked
)"""
_UNDOUBLE = rf"'([^{LETTERS}0-9])[^{LETTERS}0-9]', '\1', 'g'"
#: Capitals of everything but the protected tokens.
UPPER_SQL = f"""(WITH d AS (SELECT regexp_replace(unit, '([^{LETTERS}0-9])', '\\1\\1', 'g') AS t), p AS (
  SELECT string_split_regex(t, '{TOKENS_SQL}') AS parts, regexp_extract_all(t, '{TOKENS_SQL}', 1) AS a, regexp_extract_all(t, '{TOKENS_SQL}', 2) AS b FROM d)
  SELECT array_to_string(list_transform(range(len(parts)), lambda i: upper(replace(regexp_replace(parts[i + 1], {_UNDOUBLE}), 'ß', 'ss')) || regexp_replace(coalesce(a[i + 1], '') || coalesce(b[i + 1], ''), {_UNDOUBLE})), '') FROM p)"""


def resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.resolve(R.distinct_units(cased(spark, sf_dir)), ROSTER, glossary(spark), cache(spark, sf_dir))


@query(f"WITH {RESOLVED_SQL} SELECT unit, uses, via, en FROM resolved")
def unit_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolved(spark, sf_dir).select("unit", "uses", "via", "en")


@query(f"""WITH {RESOLVED_SQL} SELECT unit, {HASH} % 256 AS chunk_group, (row_number() OVER (PARTITION BY {HASH} % 256 ORDER BY length(unit), unit) - 1) // 25 AS chunk FROM resolved WHERE via = 'backend'""")
def warm_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.chunks(R.remainder(resolved(spark, sf_dir)).select("unit"), 25)


@query(f"""WITH {RESOLVED_SQL}, asked AS (SELECT unit, {UPPER_SQL} AS en FROM resolved WHERE via = 'backend')
SELECT unit, via, en, 'ok' AS status FROM resolved WHERE via <> 'backend' UNION ALL SELECT unit, 'backend', en, {CLASSIFY_SQL} FROM asked""")
def translate_fake_backend(spark: SparkSession, sf_dir: str) -> DataFrame:
    distinct = R.distinct_units(cased(spark, sf_dir)).select("unit")
    return R.translate_units(distinct, B.UpperBackend(), CONTEXT, glossary(spark), cache(spark, sf_dir)).select("unit", "via", "en", "status")


_FIRST = f"""{CASED}, first AS (SELECT unit, CASE WHEN {HASH} % 2 = 0 THEN NULL ELSE lower(unit) END AS en, CASE WHEN {HASH} % 2 = 0 THEN 'failed' ELSE 'ok' END AS status FROM (SELECT DISTINCT unit FROM cased))"""


def _first(spark: SparkSession, sf_dir: str) -> DataFrame:
    even = text_hash(F.col("unit")) % 2 == 0
    distinct = cased(spark, sf_dir).select("unit").distinct()
    return staged(distinct.select("unit", F.when(~even, F.lower("unit")).alias("en"), F.when(even, "failed").otherwise("ok").alias("status")), "first-pass")


@query(f"WITH {_FIRST}, again AS (SELECT unit, {UPPER_SQL} AS en FROM first WHERE status <> 'ok') SELECT unit, en, status FROM first WHERE status = 'ok' UNION ALL SELECT unit, en, {CLASSIFY_SQL} FROM again")
def fallback_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.second_pass(_first(spark, sf_dir), B.UpperBackend(), CONTEXT)


@query(f"""WITH {CASED}{CACHE_SQL}, again AS (SELECT unit, {UPPER_SQL} AS en FROM (SELECT source AS unit FROM cache WHERE status <> 'ok'))
SELECT CAST(count(*) FILTER ({CLASSIFY_SQL} = 'ok') AS BIGINT) AS recovered, count(*) AS total FROM again""")
def retry_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = cache(spark, sf_dir)
    first = C.pending(before).select(F.col("source").alias("unit"), "en", "status")
    return R.retry_counts(before, R.second_pass(first, B.UpperBackend(), CONTEXT))


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = cache(spark, sf_dir).select("namespace", "source", "en", "status", "kind")
    later = entries.where("kind = 1").select("namespace", "source", F.lower("source").alias("en"), F.lit("ok").alias("status"), F.lit(2).cast("long").alias("seq"))
    return entries.drop("kind").withColumn("seq", F.lit(1).cast("long")).unionByName(later)


@query(f"WITH {CASED}{CACHE_SQL} SELECT 'upper:0' AS namespace, source, CASE WHEN kind = 1 THEN lower(source) ELSE en END AS en, CASE WHEN kind = 1 THEN 'ok' ELSE status END AS status, CAST(1 + kind AS BIGINT) AS seq FROM cache")
def cache_upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.upsert_latest(_log(spark, sf_dir))


@query(f"WITH {CASED}{CACHE_SQL} SELECT status, count(*) AS entries FROM cache GROUP BY status")
def cache_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.statistics(cache(spark, sf_dir))


@query(f"WITH {CASED}{CACHE_SQL} SELECT source, en, status FROM cache WHERE status <> 'ok'")
def cache_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.pending(cache(spark, sf_dir)).select("source", "en", "status")


_AUDITED = f"SELECT source AS unit, CASE WHEN {HASH.replace('unit', 'source')} % 2 = 0 THEN source ELSE 'CLUSTER' END AS en FROM (SELECT unit AS source FROM cased UNION SELECT 'Grupo' UNION SELECT 'with.' UNION SELECT 'PENASCO' UNION SELECT 'Litoral')"


@query(f"WITH {CASED}, t AS ({_AUDITED}) SELECT unit AS source, en FROM t WHERE {GUARDED_SQL.split(' OR ')[0].lstrip('(')} AND trim(coalesce(en, '')) <> trim(unit)")
def cache_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.operators.entities import poisoned_entries

    more = spark.createDataFrame([("Grupo",), ("with.",), ("PENASCO",), ("Litoral",)], "source string")
    sources = cased(spark, sf_dir).select(F.col("unit").alias("source")).union(more).distinct()
    return poisoned_entries(sources.withColumn("en", F.when(text_hash(F.col("source")) % 2 == 0, F.col("source")).otherwise("CLUSTER")), ROSTER)


@query(f"""WITH {CASED}, entries AS (SELECT DISTINCT doc_id, unit AS source, CASE WHEN {HASH} % 2 = 0 THEN upper(replace(unit, 'ß', 'ss')) ELSE unit END AS en FROM cased)
SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'upper:0' ELSE 'legacy/unnamespaced' END AS namespace, source, en,
  CASE WHEN doc_id % 3 < 2 THEN 'refused' WHEN trim(source) = trim(en) THEN 'identical' ELSE 'ok' END AS status FROM entries""")
def cache_legacy_migrate(spark: SparkSession, sf_dir: str) -> DataFrame:
    entry = F.struct(F.when(text_hash(F.col("unit")) % 2 == 0, F.upper("unit")).otherwise(F.col("unit")).alias("en"), F.lit("refused").alias("status"))
    rows = cased(spark, sf_dir).select("doc_id", "unit").distinct().withColumn("e", entry)
    files = rows.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("unit", "e"))).alias("full"), F.map_from_entries(F.collect_list(F.struct("unit", "e.en"))).alias("flat"))
    shape = F.col("doc_id") % 3
    spaced = F.to_json(F.struct(F.create_map(F.lit("upper:0"), F.col("full")).alias("namespaces")))
    value = F.when(shape == 0, spaced).when(shape == 1, F.to_json("full")).otherwise(F.to_json("flat"))
    return C.parse_cache(files.select(F.col("doc_id").alias("cache_file"), value.alias("value"))).withColumnRenamed("cache_file", "doc_id")


@query(f"""WITH {CASED}{CACHE_SQL}, per AS (SELECT doc_id, unit, count(*) AS uses FROM cased GROUP BY doc_id, unit)
SELECT doc_id, CAST(sum(uses) AS BIGINT) AS unit_count, count(*) AS unique_count, count(c.source) AS cache_hits,
  CAST(sum(CASE WHEN c.source IS NULL THEN ceil(length(unit) / 4.0) + 50 ELSE 0 END) AS BIGINT) AS billed_tokens,
  sum(CASE WHEN c.source IS NULL THEN ceil(length(unit) / 4.0) + 50 ELSE 0 END) * 6.0::DOUBLE / 1e6 AS usd
FROM per LEFT JOIN cache c ON c.source = unit AND c.status = 'ok' GROUP BY doc_id""")
def estimate_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = C.usable(cache(spark, sf_dir))
    return P.document_estimate(cased(spark, sf_dir), hits, ["doc_id"], *P.PRICES["claude-haiku-4-5"], system_tokens=50)


@query(f"""WITH {RESOLVED_SQL}, chunked AS (SELECT {HASH} % 256 AS g, (row_number() OVER (PARTITION BY {HASH} % 256 ORDER BY length(unit), unit) - 1) // 25 AS c FROM resolved WHERE via = 'backend'),
priced AS (SELECT count(*) AS units, count(*) * 100 AS tin, count(*) * 50 AS tout, CASE WHEN c % 2 = 0 THEN count(*) * 1.5::DOUBLE END AS usd FROM chunked GROUP BY g, c)
SELECT CAST(sum(units) AS BIGINT) AS unit_count, CAST(sum(tin) AS BIGINT) AS input_tokens, CAST(sum(tout) AS BIGINT) AS output_tokens,
  CAST(coalesce(sum(units) FILTER (usd IS NOT NULL), 0) AS BIGINT) AS priced_units, sum(usd) AS usd FROM priced""")
def estimate_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = R.chunks(R.remainder(resolved(spark, sf_dir)).select("unit"), 25).groupBy("chunk_group", "chunk").agg(F.count(F.lit(1)).alias("units"))
    usd = F.when(F.col("chunk") % 2 == 0, F.col("units") * 1.5)
    return P.chunk_estimate(counted.select("units", (F.col("units") * 100).alias("input_tokens"), (F.col("units") * 50).alias("output_tokens"), usd.alias("usd")))


_MODELS = [*((m, *rates) for m, rates in P.PRICES.items()), ("unpriced", None, None)]
_MODELS_SQL = ", ".join(f"('{m}', {'NULL' if a is None else a}, {'NULL' if b is None else b})" for m, a, b in _MODELS)


@query(f"""WITH {RESOLVED_SQL}, total AS (SELECT count(*) AS units, CAST(coalesce(sum(ceil(length(unit) / 4.0) + 200), 0) AS BIGINT) AS tokens FROM resolved WHERE via = 'backend')
SELECT model, units, tokens AS input_tokens, tokens AS output_tokens, (tokens * CAST(i AS DOUBLE) + tokens * CAST(o AS DOUBLE)) / 1e6 AS usd FROM (VALUES {_MODELS_SQL}) AS m(model, i, o), total""")
def llm_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    models = spark.createDataFrame(_MODELS, "model string, in_rate double, out_rate double")
    return P.llm_cost(R.remainder(resolved(spark, sf_dir)), models, system_tokens=200)


_STATUS_SQL = f"""{RESOLVED_SQL}, done AS (
  SELECT unit, via, CASE WHEN via <> 'backend' THEN 'ok' WHEN {HASH} % 5 = 0 THEN 'failed' WHEN {HASH} % 5 = 1 THEN 'refused' ELSE 'ok' END AS status FROM resolved)"""


def _done(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = text_hash(F.col("unit")) % 5
    status = F.when(F.col("via") != "backend", "ok").when(kind == 0, "failed").when(kind == 1, "refused").otherwise("ok")
    return resolved(spark, sf_dir).select("unit", "via", status.alias("status"))


@query(f"""WITH {_STATUS_SQL} SELECT CASE WHEN via = 'protected' THEN 'protected_fragment' WHEN via IN ('glossary', 'cache') THEN via WHEN status = 'ok' THEN 'translated' ELSE status END AS outcome, count(*) AS units
FROM done GROUP BY 1""")
def translator_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.outcomes(_done(spark, sf_dir))


@query(f"""WITH {_STATUS_SQL}, parts AS (SELECT c.doc_id, c.page_no, c.line_no, d.* FROM cased c JOIN done d USING (unit))
SELECT doc_id, count(DISTINCT page_no) AS pages, count(*) AS paragraphs, count(*) FILTER (status = 'ok' AND via <> 'protected') AS translated, count(*) FILTER (via = 'protected') AS skipped,
  count(*) FILTER (status <> 'ok') AS failed, CAST(least(10, count(*) FILTER (status <> 'ok')) AS INT) AS listed FROM parts GROUP BY doc_id""")
def pdf_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = cased(spark, sf_dir).join(_done(spark, sf_dir), "unit")
    return P.document_report(parts, ["doc_id"]).select("doc_id", "pages", "paragraphs", "translated", "skipped", "failed", F.size("failures").alias("listed"))


@query("""SELECT CASE WHEN lang = 'en' THEN 'pdf' ELSE 'office' END AS kind, count(*) FILTER (doc_id % 4 = 0) AS ok, count(*) FILTER (doc_id % 4 = 1) AS skipped,
  count(*) FILTER (doc_id % 4 = 2 OR (lang <> 'en' AND n_chars % 7 = 0)) AS errors, count(*) FILTER (doc_id % 4 = 3) AS copied FROM documents GROUP BY 1""")
def batch_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("doc_id") % 4
    status = F.when(kind == 0, "ok").when(kind == 1, "skipped").when(kind == 2, "error").otherwise("copied")
    documents = table(spark, sf_dir, "documents").select(F.when(F.col("lang") == "en", "pdf").otherwise("office").alias("kind"), status.alias("status"), (F.col("n_chars") % 7 == 0).cast("int").alias("lost_parts"))
    return P.batch_summary(documents)


class SloppyBackend(B.Backend):
    """Stand-in that garbles numbers and names which are not protected, and loses placeholders of some texts."""

    name, prefers_batch, max_batch = "sloppy", True, 25

    def translate(self, text: str, context: B.Context) -> B.Result:
        if "[[" in text:
            return B.Result(text.upper().replace("[[", "[") if text.startswith("Pagar") else text.upper())
        return B.Result(text.upper().replace("37", "73").replace("GRUPO", "GROUP"))


_GARBLED = "replace(replace(upper(replace(unit, 'ß', 'ss')), '37', '73'), 'GRUPO', 'GROUP')"


@query(rf"""WITH {CASED}, u AS (SELECT DISTINCT unit FROM cased), v AS (SELECT unit, {_GARBLED} AS en, {VERIFIED_SQL.format(en=_GARBLED)} AS good FROM u)
SELECT unit, CASE WHEN good THEN en WHEN starts_with(unit, 'Pagar') THEN NULL ELSE {UPPER_SQL} END AS en, CASE WHEN NOT good AND starts_with(unit, 'Pagar') THEN 'failed' ELSE 'ok' END AS status FROM v""")
def verify_retry(spark: SparkSession, sf_dir: str) -> DataFrame:
    distinct = R.distinct_units(cased(spark, sf_dir)).select("unit")
    return B.call_verified(distinct, SloppyBackend(), CONTEXT).withColumnRenamed("call_status", "status")


@query(rf"""WITH {CASED}, {TERMS_SQL}{CACHE_SQL}, m AS (SELECT *, {GUARDED_SQL} AS guarded, regexp_extract(unit, '{MARKER_SQL}', 1) AS marker, regexp_replace(unit, '{MARKER_SQL}', '') AS body FROM units),
o AS (SELECT *, regexp_extract(upper(strip_accents(body)), '^({ORDINAL_SQL})(?:[.,: )]|$)', 1) AS spanish FROM m), s AS (SELECT *, regexp_extract(substr(body, length(spanish) + 1), '^([.,:]*)', 1) AS signs FROM o),
final AS (SELECT doc_id, page_no, guarded, CASE WHEN guarded THEN unit WHEN spanish <> '' THEN ltrim(substr(body, length(spanish) + length(signs) + 1)) ELSE body END AS rest FROM s),
d AS (SELECT DISTINCT rest AS unit FROM final WHERE rest <> ''), looked AS (
  SELECT unit, {GUARDED_SQL} AS guarded, coalesce(a.translation, regexp_extract(unit, '{_HEADED}', 1) || ' ' || b.translation) AS hit, c.en AS cached FROM d LEFT JOIN terms a ON a.term = unit
  LEFT JOIN terms b ON regexp_matches(unit, '{_HEADED}') AND b.term = trim(regexp_extract(unit, '{_HEADED}', 2)) LEFT JOIN cache c ON c.source = unit AND c.status = 'ok'
), told AS (SELECT unit, guarded, hit IS NOT NULL OR cached IS NOT NULL AS known, regexp_replace({UPPER_SQL}, ',\s*,+', ',', 'g') AS en FROM looked),
done AS (SELECT unit AS rest, guarded AS kept, CASE WHEN guarded OR known THEN 'ok' ELSE {CLASSIFY_SQL} END AS status FROM told)
SELECT doc_id, count(DISTINCT page_no) AS pages, count(*) AS paragraphs, count(*) FILTER (coalesce(status, 'ok') = 'ok' AND NOT guarded AND NOT coalesce(kept, false)) AS translated, count(*) FILTER (guarded OR coalesce(kept, false)) AS skipped,
  count(*) FILTER (coalesce(status, 'ok') <> 'ok') AS failed FROM final LEFT JOIN done USING (rest) GROUP BY doc_id""")
def translate_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole plan: per document, what became of its lines."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    units, _ = translate_documents(documents, B.UpperBackend(), CONTEXT, glossary(spark), cache(spark, sf_dir), rules.DATE_RULES)
    return P.document_report(units, ["doc_id"]).drop("failures")


@query(f"WITH {CASED} SELECT doc_id, line_no, unit = upper(replace(unit, 'ß', 'ss')) AS equal_text, replace(lower(strip_accents(unit)), 'ß', 'ss') = replace(lower(strip_accents(upper(replace(unit, 'ß', 'ss')))), 'ß', 'ss') AS equal_folded FROM cased")
def folded_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = F.col("unit")
    return cased(spark, sf_dir).select("doc_id", "line_no", (unit == F.upper(unit)).alias("equal_text"), X.equal_folded(unit, F.upper(unit)).alias("equal_folded"))
