"""Queries over whole runs: reports of batches and of drawn documents, and what an editor is given."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import batch as A
from quire.operators import render as D
from quire.operators import report as P
from quire.queries import query, table
from quire.queries.common import CASED, LINES, cased
from quire.queries.documents import paragraph_rows
from quire.queries.geometry import GEOMETRY, lined
from quire.sources import documents as S

_RUN_SQL = """d AS (SELECT 'in/' || doc_id AS src, CASE doc_id % 4 WHEN 0 THEN 'pdf' WHEN 1 THEN 'office' WHEN 2 THEN 'copy' ELSE 'none' END AS kind, doc_id % 5 AS mtime, doc_id FROM documents),
planned AS (SELECT *, NOT (doc_id % 3 <> 0 AND doc_id % 7 >= mtime) AS due FROM d WHERE kind <> 'none'),
told AS (SELECT *, CASE WHEN due AND doc_id % 13 = 0 THEN 'no result' WHEN due AND doc_id % 11 = 0 THEN 'bad file' END AS e FROM planned), report AS (
  SELECT kind, src, CASE WHEN NOT due THEN 'skipped' WHEN e IS NOT NULL THEN 'ERROR' WHEN kind = 'copy' THEN 'copied' ELSE 'ok' END AS status,
    coalesce(e, CASE WHEN due AND kind = 'office' AND doc_id % 9 = 0 THEN 'LOST PARTS: a.xml, b.xml' END) AS error FROM told)"""


def _report(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.col("doc_id")
    rows = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("in/"), number.cast("string")).alias("src"))
    kind = F.element_at(F.array(*map(F.lit, [*A.ONLY[:2], "copy", "none"])), (number % 4 + 1).cast("int"))
    outputs = rows.where(number % 3 != 0).select("src", (number % 7).alias("mtime"))
    lost = F.when(number % 9 == 0, F.array(F.lit("b.xml"), F.lit("a.xml")))
    results = rows.where(number % 13 != 0).select("src", F.when(number % 11 == 0, "bad file").alias("error"), lost.alias("lost_parts"))
    return A.corpus_report(A.plan(rows.select("src", kind.alias("kind"), (number % 5).alias("mtime")), outputs), results)


@query(f"WITH {_RUN_SQL} SELECT * FROM report")
def corpus_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _report(spark, sf_dir)


@query(f"WITH {_RUN_SQL} SELECT src, error FROM report WHERE error IS NOT NULL")
def corpus_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.errors(_report(spark, sf_dir))


@query(f"""WITH {CASED}, parts AS (SELECT *, CASE WHEN line_no % 9 = 0 THEN 'protected' ELSE 'backend' END AS via, CASE WHEN line_no % 9 <> 0 AND line_no % 5 = 0 THEN 'failed' ELSE 'ok' END AS status FROM cased),
whole AS (SELECT doc_id, count(DISTINCT page_no) AS pages, count(*) AS paragraphs, count(*) FILTER (via <> 'protected' AND status = 'ok') AS translated, count(*) FILTER (via = 'protected') AS skipped, count(*) FILTER (status = 'failed') AS failed,
  count(*) FILTER (via <> 'protected' AND status = 'ok' AND length(unit) > 60) AS scaled, count(*) FILTER (via <> 'protected' AND status = 'ok' AND length(unit) > 90) AS overflow,
  coalesce(string_agg((page_no + 1) || ':' || left(unit, 90), '|' ORDER BY line_no) FILTER (via <> 'protected' AND status = 'ok' AND length(unit) > 90), '') AS overflow_detail FROM parts GROUP BY doc_id)
SELECT w.*, CASE WHEN d.doc_id % 3 = 0 THEN 'scan' ELSE 'digital' END AS kind, CASE WHEN d.doc_id % 3 = 0 THEN translated ELSE 0 END AS inpainted,
  CASE WHEN d.doc_id % 5 = 0 THEN '' ELSE 'Foo=arial' END AS substitutions FROM whole w JOIN documents d USING (doc_id)""")
def full_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.col("line_no")
    via = F.when(number % 9 == 0, "protected").otherwise("backend")
    parts = cased(spark, sf_dir).withColumn("via", via).withColumn("status", F.when((number % 9 != 0) & (number % 5 == 0), "failed").otherwise("ok"))
    length = F.length("unit")
    drawn = parts.where("via <> 'protected' AND status = 'ok'").select("doc_id", "page_no", number.alias("place"), F.col("unit").alias("text"), (length > 60).alias("scaled"), (length > 90).alias("overflow"))
    documents = table(spark, sf_dir, "documents").select("doc_id")
    kinds = documents.withColumn("kind", F.when(F.col("doc_id") % 3 == 0, "scan").otherwise("digital"))
    substituted = (F.col("doc_id") % 5 != 0).alias("substituted")
    fonts = documents.select("doc_id", F.lit("Foo").alias("font"), F.lit("arial").alias("resolved"), substituted)
    fonts = fonts.unionByName(documents.select("doc_id", F.lit("Arial").alias("font"), F.lit("arial").alias("resolved"), F.lit(False).alias("substituted")))
    found = P.full_report(parts, drawn, kinds, fonts, ["doc_id"])
    detail = F.array_join(F.transform("overflow_detail", lambda x: F.concat(x["page"].cast("string"), F.lit(":"), x["text"])), "|")
    pairs = F.array_join(F.transform(F.map_entries("font_substitutions"), lambda x: F.concat(x["key"], F.lit("="), x["value"])), "|")
    return found.select("doc_id", "pages", "paragraphs", "translated", "skipped", "failed", "scaled", "overflow", F.coalesce(detail, F.lit("")).alias("overflow_detail"), "kind", "inpainted", pairs.alias("substitutions"))


@query(f"""WITH {CASED}, w AS (SELECT doc_id, line_no, length(unit) AS n, length(unit) - length(replace(unit, ' ', '')) AS gaps, list_extract(['left', 'center', 'right', 'justify'], 1 + line_no % 4) AS align, line_no % 3 = 0 AS is_last FROM cased),
f AS (SELECT *, 11.0::DOUBLE * 0.55::DOUBLE AS blank, 11.0::DOUBLE * 0.55::DOUBLE * n AS natural_width, 400.0::DOUBLE - 11.0::DOUBLE * 0.55::DOUBLE * n AS free FROM w)
SELECT doc_id, line_no, natural_width, CASE align WHEN 'center' THEN greatest(0.0::DOUBLE, free / 2) WHEN 'right' THEN greatest(0.0::DOUBLE, free) ELSE 0.0::DOUBLE END AS x_offset,
  CASE WHEN align = 'justify' AND NOT is_last AND gaps > 0 AND free > 0 THEN least(blank + free / greatest(1, gaps), blank * 2.6::DOUBLE) ELSE blank END AS space_width FROM f""")
def line_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    align = F.element_at(F.array(*map(F.lit, ["left", "center", "right", "justify"])), F.col("line_no") % 4 + 1)
    lines = cased(spark, sf_dir).select("doc_id", "line_no", F.split("unit", " ").alias("words"), F.lit(11.0).alias("size"), align.alias("align"), (F.col("line_no") % 3 == 0).alias("is_last"), F.lit(400.0).alias("room"))
    return D.line_facts(lines).select("doc_id", "line_no", "natural_width", "x_offset", "space_width")


@query(f"WITH {GEOMETRY} SELECT doc_id, line_no, x0 - 0.75::DOUBLE AS clear_x0, y0 - size * 0.8::DOUBLE AS clear_y0, x1 + 0.75::DOUBLE AS clear_x1, y1 + size * 0.22::DOUBLE AS clear_y1 FROM lined")
def reflow_clear_rects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.clear_rects(lined(spark, sf_dir)).select("doc_id", "line_no", "clear_x0", "clear_y0", "clear_x1", "clear_y1")


@query(f"""WITH {LINES} SELECT CAST(doc_id AS VARCHAR) AS source, page_no, CAST(1 AS INT) AS schema_no, CAST(page_no AS INT) AS number, CAST(round_even(612 * (110 / 72.0::DOUBLE), 0) AS INT) AS px_width,
  CAST(round_even(792 * (110 / 72.0::DOUBLE), 0) AS INT) AS px_height, CAST(count(*) AS INT) AS paragraphs, string_agg(line, chr(10) ORDER BY line_no) AS text FROM lines GROUP BY doc_id, page_no""")
def layout_envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The envelopes' JSON, read again."""
    form = f"struct<schema:int,source:string,pages:array<{S.PAGE}>,render:struct<zoom:double,pages:array<struct<number:int,px_width:int,px_height:int>>>>"
    read = S.layout_envelopes(paragraph_rows(spark, sf_dir)).select("page_no", F.from_json("value", form).alias("e"))
    picture, page = F.col("e.render.pages")[0], F.col("e.pages")[0]
    return read.select(
        "e.source", "page_no", F.col("e.schema").alias("schema_no"), picture["number"].alias("number"), picture["px_width"].alias("px_width"), picture["px_height"].alias("px_height"),
        F.size(page["paragraphs"]).alias("paragraphs"), F.array_join(F.transform(page["paragraphs"], lambda q: q["text"]), "\n").alias("text"),
    )


@query(f"WITH {LINES} SELECT doc_id, page_no, page_no IN (0, 2) AS selected, count(*) AS n_lines FROM lines GROUP BY doc_id, page_no")
def page_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that were asked for and those that stay as they are."""
    rows = paragraph_rows(spark, sf_dir).groupBy(F.col("source").cast("long").alias("doc_id"), "page_no").agg(F.count(F.lit(1)).alias("n_lines"))
    return S.marked_pages(rows, "1, 3").select("doc_id", "page_no", "selected", "n_lines")
