"""Derived inputs that several queries share, and the SQL that derives them alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.plans.translate import text_hash, units_of
from quire.queries import table

#: Roster and glossary that the generated documents have hits for.
ROSTER = ["Grupo Aurora, SRL.", "Grupo Peñasco", "Banco Litoral", "that with", "MICM"]
GLOSSARY = [("Cantidad", "Quantity", "construction", 0), ("Monto", "Amount", "construction", 0), ("Monto", "Sum", "legal", 1), ("Tasa", "Rate", "construction", 0), ("Acero", "Steel", "construction", 0), ("Tasa", "Rate", "legal", 1)]

LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
LINES = r"""lines AS (
  SELECT doc_id, CAST(i AS INT) AS line_no, CAST(i // 40 AS INT) AS page_no, parts[i + 1] AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents) t, unnest(range(len(t.parts))) AS u(i)
)"""
CLEANED = r"trim(regexp_replace(regexp_replace(line, '[\x{E000}-\x{F8FF}\x{200B}-\x{200D}\x{FEFF}]', '', 'g'), '\s+', ' ', 'g'))"
UNITS = LINES + rf""", units AS (
  SELECT * FROM (SELECT doc_id, line_no, page_no, {CLEANED} AS unit FROM lines)
  WHERE unit <> '' AND regexp_matches(unit, '[{LETTERS}]') AND NOT regexp_matches(unit, '^[\d.,()%\-\s–—°ºª/:$]*$')
    AND unit NOT IN ('•', '●', '○', '◦', '▪', '§', '·', '-', '—', '–')
)"""
HASH = "CAST('0x' || substr(md5(unit), 1, 7) AS BIGINT)"
#: Lines with the cases that generated prose lacks; they are added after the real lines at fixed places.
CASES = [
    (0, "Grupo"), (1, "GRUPO AURORA, SRL."), (2, "Monto"), (3, "2.26 Cantidad"), (4, "a) Primero. El monto"), (5, "DÉCIMO CUARTO: dicho contrato"), (6, "12. Tasa"),
    (7, "Pagar RD$1,250.50 o US$400 a Banco Litoral y 37 más"), (8, "(iv) VIGESIMO TERCERO., del MICM"), (9, "TRIGESIMO."), (10, "Peñasco, Grupo Peñasco"),
]
#: Numbers of added lines: that of the line they follow and this.
ADDED = 1_000_000
CASED = UNITS + f""", cased AS (
  SELECT doc_id, line_no, page_no, unit FROM units
  UNION ALL SELECT doc_id, CAST(line_no + {ADDED} AS INT), page_no, text FROM units JOIN (VALUES {", ".join(f"({n}, '{t}')" for n, t in CASES)}) AS c(n, text) ON line_no % 23 = n
)"""
#: Openings put before real lines at fixed places, for what depends on how a line begins.
OPENINGS = [(4, "a) "), (6, "12. "), (8, "(iv) "), (9, "TRIGESIMO. "), (10, "• ")]
OPENED = UNITS + ", opened AS (SELECT doc_id, line_no, page_no, CASE line_no % 23 " + " ".join(f"WHEN {n} THEN '{t}'" for n, t in OPENINGS) + " ELSE '' END || unit AS unit FROM units)"
GLOSSARY_SQL = "glossary(term, translation, domain, priority) AS (VALUES " + ", ".join(f"('{a}', '{b}', '{c}', {d})" for a, b, c, d in GLOSSARY) + ")"
TERMS_SQL = GLOSSARY_SQL + ", terms AS (SELECT term, max_by(translation, priority) AS translation, count(DISTINCT translation) > 1 AS collision FROM glossary GROUP BY term)"
#: A third of the distinct units have a cache entry, of each status.
CACHE_SQL = f""", cache AS (
  SELECT unit AS source, CASE WHEN h // 3 % 4 IN (0, 2) THEN upper(replace(unit, 'ß', 'ss')) END AS en,
    CASE h // 3 % 4 WHEN 0 THEN 'ok' WHEN 1 THEN 'failed' WHEN 2 THEN 'identical' ELSE 'refused' END AS status, h % 2 AS kind, h
  FROM (SELECT DISTINCT unit, {HASH} AS h FROM cased) WHERE h % 3 = 0
)"""


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return units_of(table(spark, sf_dir, "documents"))


def cased(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All real units, and the cases as lines of their own."""
    own = F.array(F.struct(F.col("line_no"), F.col("unit")))
    added = F.filter(F.array(*(F.struct((F.col("line_no") + ADDED).alias("line_no"), F.when(F.col("line_no") % 23 == n, text).alias("unit")) for n, text in CASES)), lambda c: c["unit"].isNotNull())
    return units(spark, sf_dir).select("doc_id", "page_no", F.explode(F.concat(own, added)).alias("c")).select("doc_id", "c.line_no", "page_no", "c.unit")


def opened(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All real units, some with an opening before them."""
    opening = F.lit("")
    for n, text in OPENINGS:
        opening = F.when(F.col("line_no") % 23 == n, text).otherwise(opening)
    return units(spark, sf_dir).withColumn("unit", F.concat(opening, "unit"))


def glossary(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(GLOSSARY, "term string, translation string, domain string, priority int")


def cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    distinct = cased(spark, sf_dir).select("unit").distinct().withColumn("h", text_hash(F.col("unit"))).where("h % 3 = 0")
    kind = F.expr("h DIV 3 % 4")
    status = F.when(kind == 0, "ok").when(kind == 1, "failed").when(kind == 2, "identical").otherwise("refused")
    return distinct.select(
        F.lit("upper:0").alias("namespace"), F.col("unit").alias("source"), F.when(kind.isin(0, 2), F.upper("unit")).alias("en"), status.alias("status"), (F.col("h") % 2).alias("kind"), "h"
    )
