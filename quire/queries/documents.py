"""Queries over documents, parts, jobs and uploads."""

from __future__ import annotations

import io
import zipfile

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions.text import page_numbers
from quire.operators import jobs as J
from quire.operators import office as O
from quire.plans.staging import staged
from quire.plans.translate import lines_of
from quire.queries import query, table
from quire.queries.common import LINES
from quire.sources import documents as S

#: Opening of a line that is written in hexadecimal.
HEXADECIMAL = "hex:"


@query(f"""WITH {LINES}, paged AS (SELECT l.doc_id, page_no, CASE WHEN l.doc_id % 10 = 0 THEN '' ELSE trim(string_agg(line, chr(10) ORDER BY line_no), ' ') END AS text, any_value(source) AS source FROM lines l JOIN documents USING (doc_id) GROUP BY l.doc_id, page_no)
SELECT doc_id, count(*) AS pages, CAST(sum(length(text)) AS BIGINT) AS chars,
  CASE WHEN sum(length(text)) < 40 * count(*) THEN 'scan' WHEN any_value(source) = 'src0' THEN 'ocr' ELSE 'digital' END AS kind FROM paged GROUP BY doc_id""")
def classify_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n")
    pages = lines_of(documents).groupBy("doc_id", "page_no").agg(text.alias("joined")).join(documents.select("doc_id", "source"), "doc_id")
    fonts = F.when(F.col("source") == "src0", F.array(F.lit("GlyphLessFont"))).when(F.col("source") == "src1", F.array(F.lit("GlyphLessFont"), F.lit("Arial"))).otherwise(F.array(F.lit("Arial")))
    return J.classify_documents(pages.select("doc_id", F.when(F.col("doc_id") % 10 == 0, "").otherwise(F.col("joined")).alias("text"), fonts.alias("fonts")), ["doc_id"])


@query(f"""WITH {LINES}, b AS (SELECT doc_id, doc_id - 1 AS pair, line_no, line FROM lines), a AS (SELECT doc_id AS pair, line_no, line FROM lines)
SELECT pair, line_no, CASE WHEN b.line IS NULL THEN 'lost' WHEN a.line IS NULL THEN 'added' ELSE 'changed' END AS change FROM a FULL JOIN b USING (pair, line_no) WHERE a.line IS DISTINCT FROM b.line""")
def part_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = lines_of(table(spark, sf_dir, "documents"))
    a, b = lines.select(F.col("doc_id").alias("pair"), "line_no", "line"), lines.select((F.col("doc_id") - 1).alias("pair"), "line_no", "line")
    return O.part_diff(a, b, ["pair", "line_no"], "line")


@query(f"""WITH {LINES} SELECT CAST(doc_id AS VARCHAR) AS doc, 0 AS part_no, 'word/document.xml' AS part_name, CAST(line_no AS INT) AS node_no, line AS text FROM lines WHERE line <> ''""")
def office_text_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text nodes of a word part made from each document's lines."""
    return O.text_nodes(_parts(spark, sf_dir)).withColumn("text", _read("text"))


def _held(line: Column | str) -> Column:
    """A line as a part holds it: one with characters that XML refuses or changes is written in hexadecimal."""
    column = F.col(line) if isinstance(line, str) else line
    return F.when(column.rlike(r"[\x00-\x08\x0B-\x1F\x{FFFE}\x{FFFF}]") | column.startswith(HEXADECIMAL), F.concat(F.lit(HEXADECIMAL), F.hex(column.cast("binary")))).otherwise(column)


def _read(held: str) -> Column:
    """The line that a part holds as ``held``."""
    return F.when(F.col(held).startswith(HEXADECIMAL), F.decode(F.unhex(F.substr(F.col(held), F.lit(len(HEXADECIMAL) + 1))), "UTF-8")).otherwise(F.col(held))


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = _held("line")
    for mark, reference in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        line = F.replace(line, F.lit(mark), F.lit(reference))
    node = F.concat(F.lit("<w:p><w:r><w:t>"), line, F.lit("</w:t></w:r></w:p>"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", node.alias("x")))), lambda x: x["x"]), "")
    made = lines_of(table(spark, sf_dir, "documents")).groupBy("doc_id").agg(body.alias("body"))
    xml = F.concat(F.lit(f'<w:document xmlns:w="{O.WORD_NS}">'), F.col("body"), F.lit("</w:document>"))
    return made.select(F.col("doc_id").cast("string").alias("doc"), F.lit(0).alias("part_no"), F.lit("word/document.xml").alias("part_name"), xml.cast("binary").alias("bytes"))


@query(f"""WITH {LINES} SELECT CAST(doc_id AS VARCHAR) AS doc, CAST(count(*) FILTER (line = first_line) AS INT) AS replaced
FROM (SELECT l.doc_id, line, (SELECT min(line) FROM lines) AS first_line FROM lines l) GROUP BY doc_id""")
def office_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = lines_of(table(spark, sf_dir, "documents")).agg(F.min("line").alias("line")).select(_held("line")).first()[0]
    translations = spark.createDataFrame([(first, "replaced" if first != "replaced" else "replaced again")], "source string, en string")
    return O.rewrite_parts(_parts(spark, sf_dir), translations).select("doc", "replaced")


def _packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A package of each document: its word part between two entries that must survive as they are."""

    def pack(batches):
        for batch in batches:
            for doc, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                out = io.BytesIO()
                with zipfile.ZipFile(out, "w") as package:
                    for name, data, kind in (("[Content_Types].xml", b"<Types/>", zipfile.ZIP_STORED), ("word/document.xml", body, zipfile.ZIP_DEFLATED), ("media/image.bin", body[::-1], zipfile.ZIP_DEFLATED)):
                        info = zipfile.ZipInfo(name, (2001, 2, 3, 4, 5, 6))
                        info.compress_type = kind
                        package.writestr(info, data)
                yield pa.RecordBatch.from_arrays([pa.array([doc]), pa.array([out.getvalue()], pa.binary())], ["doc", "content"])

    return _parts(spark, sf_dir).select("doc", "bytes").mapInArrow(pack, "doc string, content binary")


@query(f"""WITH {LINES}, first AS (SELECT DISTINCT min(line) AS line FROM lines GROUP BY doc_id), t AS (SELECT l.doc_id, line_no, CASE WHEN f.line IS NULL THEN l.line ELSE '» ' || l.line END AS text, f.line IS NOT NULL AS hit FROM lines l LEFT JOIN first f ON f.line = l.line AND f.line <> '')
SELECT CAST(doc_id AS VARCHAR) AS doc, CAST(count(*) FILTER (hit) AS INT) AS replaced, md5(string_agg(text, '|' ORDER BY line_no) FILTER (text <> '')) AS body, true AS others_same FROM t GROUP BY doc_id""")
def office_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole packages written with their texts translated, and read again."""
    lines = lines_of(table(spark, sf_dir, "documents"))
    translations = lines.groupBy("doc_id").agg(F.min("line").alias("source")).select(_held("source").alias("source"), _held(F.concat(F.lit("» "), "source")).alias("en"))
    before = staged(_packages(spark, sf_dir), "packages")
    after = staged(O.translate_packages(before, translations), "packages")
    texts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node_no", _read("text").alias("text")))), lambda n: n["text"]), "|")
    bodies = O.text_nodes(O.parts_of(after)).groupBy("doc").agg(F.md5(texts.cast("binary")).alias("body"))
    changes = O.part_diff(O.parts_of(before), O.parts_of(after), ["doc", "part_name"]).where("part_name <> 'word/document.xml'").select("doc").distinct().withColumn("others_same", F.lit(False))
    return after.select("doc", "replaced").join(bodies, "doc", "left").join(changes, "doc", "left").withColumn("others_same", F.coalesce("others_same", F.lit(True)))


@query(r"""SELECT page_id, name, (lower(name) LIKE '%.xml') AND (contains(lower(name), 'sharedstrings') OR (lower(name) LIKE 'xl/worksheets/%' AND NOT contains(lower(name), '_rels')) OR contains(lower(name), '/drawings/')
  OR contains(lower(name), '/charts/') OR lower(name) LIKE 'word/document%' OR lower(name) LIKE 'word/header%' OR lower(name) LIKE 'word/footer%' OR lower(name) LIKE 'ppt/slides/slide%' OR lower(name) LIKE 'ppt/notesslides/%' OR contains(lower(name), 'comments')) AS is_text
FROM (SELECT page_id, ['xl/sharedStrings.xml', 'xl/worksheets/_rels/sheet1.xml', 'xl/worksheets/sheet1.xml', 'word/footnotes.xml', 'word/Header2.xml', 'ppt/slides/slide3.xml', 'ppt/media/a.png', 'xl/comments1.xml', 'ppt/notesSlides/n1.xml', url][1 + page_id % 10] AS name FROM pages)""")
def office_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["xl/sharedStrings.xml", "xl/worksheets/_rels/sheet1.xml", "xl/worksheets/sheet1.xml", "word/footnotes.xml", "word/Header2.xml", "ppt/slides/slide3.xml", "ppt/media/a.png", "xl/comments1.xml", "ppt/notesSlides/n1.xml"]
    name = F.get(F.array(*map(F.lit, names), F.col("url")), (F.col("page_id") % 10).cast("int"))
    return table(spark, sf_dir, "pages").select("page_id", name.alias("name"), O.is_text_part(name).alias("is_text"))


@query(r"SELECT page_id, list_transform(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1), lambda x: x) AS links, CAST(len(regexp_extract_all(html, '<p>')) AS INT) AS paragraphs FROM pages")
def html_text_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1)).alias("links"), F.regexp_count("html", F.lit("<p>")).cast("int").alias("paragraphs"))


@query(f"WITH {LINES} SELECT doc_id, page_no, count(*) AS n_lines FROM lines WHERE page_no IN (0, 1, 2, 4) GROUP BY doc_id, page_no")
def page_range_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = spark.range(1).select(F.explode(page_numbers(F.lit("1-3, ,5"))).alias("page_no"))
    return lines_of(table(spark, sf_dir, "documents")).join(wanted, "page_no", "left_semi").groupBy("doc_id", "page_no").agg(F.count(F.lit(1)).alias("n_lines"))


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS rel, o_orderdate AS mtime FROM orders
WHERE NOT (o_orderkey % 3 > 0 AND CASE WHEN o_orderkey % 3 = 1 THEN o_orderdate ELSE o_orderdate - INTERVAL 1 DAY END >= o_orderdate)""")
def incremental_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("rel"), F.col("o_orderdate").alias("mtime"))
    key = F.col("rel").cast("long") % 3
    outputs = sources.where(key > 0).select("rel", F.when(key == 1, F.col("mtime")).otherwise(F.col("mtime") - F.expr("INTERVAL 1 DAY")).alias("mtime"))
    return J.up_to_date(sources, outputs)


@query("SELECT doc_id, kind, row_number() OVER (ORDER BY coalesce(kind <> 'digital', true), doc_id) - 1 AS place FROM (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'scan' WHEN 1 THEN 'digital' END AS kind FROM documents)")
def scan_last_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("doc_id") % 3 == 0, "scan").when(F.col("doc_id") % 3 == 1, "digital")
    ordered = J.scan_last(table(spark, sf_dir, "documents").select("doc_id", kind.alias("kind")), "doc_id")
    # Places within ranges of the order, each begun where the ranges before it end; no task sees more than a range.
    ranged = staged(ordered.withColumn("range", F.spark_partition_id()), "scan-last")
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    first = ranged.groupBy("range").agg(F.count(F.lit(1)).alias("n")).select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    within = Window.partitionBy("range").orderBy(F.coalesce(F.col("kind") != "digital", F.lit(True)), "doc_id")
    return ranged.join(F.broadcast(first), "range").select("doc_id", "kind", (F.col("first") + F.row_number().over(within) - 1).alias("place"))


_UPLOADS = """SELECT page_id, CASE page_id % 9 WHEN 0 THEN 'a.pdf' WHEN 1 THEN '../a.pdf' WHEN 2 THEN 'a.exe' WHEN 3 THEN 'A.DOCX' WHEN 4 THEN 'b.xls' WHEN 5 THEN 'empty.pdf' WHEN 6 THEN 'big.pptx' WHEN 7 THEN 'long.pdf' ELSE '' END AS name,
  CASE page_id % 9 WHEN 3 THEN '504B0304' WHEN 4 THEN '504B0304' WHEN 6 THEN '504B0304' ELSE '255044462D312E' END AS head,
  CASE page_id % 9 WHEN 5 THEN 0 WHEN 6 THEN 60000000 ELSE strlen(html) END AS size, CASE page_id % 9 WHEN 7 THEN 501 ELSE 3 END AS n_pages FROM pages"""


@query(f"""WITH u AS ({_UPLOADS}), e AS (SELECT *, lower(regexp_extract(name, '(\\.[^.]*)$', 1)) AS ext FROM u)
SELECT page_id, name, CASE WHEN name IN ('', '.', '..') OR contains(name, '/') THEN 'invalid filename' WHEN ext NOT IN ('.pdf', '.docx', '.pptx', '.xlsx', '.xls') THEN 'unsupported file type' WHEN size = 0 THEN 'empty file'
  WHEN size > 52428800 THEN 'file too large' WHEN NOT starts_with(head, CASE ext WHEN '.pdf' THEN '255044462D' WHEN '.xls' THEN 'D0CF11E0A1B11AE1' ELSE '504B0304' END) THEN 'content does not match'
  WHEN ext = '.pdf' AND n_pages > 500 THEN 'too many pages' END AS rejected FROM e""")
def upload_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id") % 9
    names = F.get(F.array(*map(F.lit, ["a.pdf", "../a.pdf", "a.exe", "A.DOCX", "b.xls", "empty.pdf", "big.pptx", "long.pdf", ""])), k.cast("int"))
    head = F.when(k.isin(3, 4, 6), "504B0304").otherwise("255044462D312E")
    size = F.when(k == 5, 0).when(k == 6, 60000000).otherwise(F.octet_length("html"))
    return table(spark, sf_dir, "pages").select("page_id", names.alias("name"), J.rejection(names, head, size, F.when(k == 7, 501).otherwise(3)).alias("rejected"))


@query("""SELECT user_id AS job_id, CASE WHEN user_id % 7 = 0 THEN 'cancelled' WHEN bool_or(event_type = 'purchase') THEN 'failed' ELSE 'done' END AS status FROM events GROUP BY user_id""")
def job_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    files = events.select(F.col("user_id").alias("job_id"), F.when(F.col("event_type") == "purchase", "failed").otherwise("done").alias("status"))
    return J.job_status(files, events.select(F.col("user_id").alias("job_id"), (F.col("user_id") % 7 == 0).alias("cancelled")).distinct())


@query("SELECT user_id % 50 AS visitor_id, count(*) AS active FROM events WHERE event_id % 5 IN (0, 1) GROUP BY 1")
def active_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_id") % 5
    status = F.when(kind == 0, "queued").when(kind == 1, "running").when(kind == 2, "done").when(kind == 3, "failed").otherwise("cancelled")
    return J.active_jobs(table(spark, sf_dir, "events").select((F.col("user_id") % 50).alias("visitor_id"), status.alias("status")))


@query("SELECT event_id AS job_id, CASE WHEN event_id = 5 AND user_id = (SELECT user_id FROM events WHERE event_id = 5) THEN 'cancelled' WHEN event_id % 5 IN (0, 1) THEN 'failed' WHEN event_id % 5 = 2 THEN 'done' WHEN event_id % 5 = 3 THEN 'failed' ELSE 'cancelled' END AS status FROM events")
def job_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_id") % 5
    status = F.when(kind == 0, "queued").when(kind == 1, "running").when(kind == 2, "done").when(kind == 3, "failed").otherwise("cancelled")
    jobs = table(spark, sf_dir, "events").select(F.col("event_id").alias("job_id"), F.col("user_id").cast("string").alias("visitor_id"), status.alias("status"))
    visitor = jobs.where("job_id = 5").first().visitor_id
    return J.recovered(J.cancelled(jobs, 5, visitor)).select("job_id", "status")


def paragraph_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as paragraphs of documents, with fields left absent."""
    rect = F.struct(F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), F.lit(1.0).alias("x1"), F.lit(1.0).alias("y1"))
    none = F.lit(None).cast("double")
    return lines_of(table(spark, sf_dir, "documents")).select(
        F.col("doc_id").cast("string").alias("source"), "page_no", F.lit(612.0).alias("width"), F.lit(792.0).alias("height"), F.col("line_no").alias("para_no"), F.col("line").alias("text"), F.array().cast(f"array<{S.RUN}>").alias("runs"),
        rect.alias("rect"), F.lit(0.0).alias("origin_x"), F.lit(0.0).alias("origin_y"), F.lit(None).cast("string").alias("align"), none.alias("leading"), F.lit(11.0).alias("size"), F.lit("Arial").alias("font"),
        F.lit(None).cast("array<double>").alias("color"), none.alias("indent"), none.alias("hang_x0"), F.when(F.col("line_no") % 2 == 0, True).alias("starts_item"), F.lit(None).cast(S.RECT).alias("clip"),
    )


@query(f"""WITH {LINES} SELECT CAST(doc_id AS VARCHAR) AS source, page_no, CAST(row_number() OVER (PARTITION BY doc_id, page_no ORDER BY line_no) - 1 AS INT) AS para_no, line AS text, 'left' AS align, line_no % 2 = 0 AS starts_item FROM lines""")
def document_json_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.paragraphs(S.to_documents(paragraph_rows(spark, sf_dir))).select("source", "page_no", "para_no", "text", "align", "starts_item")


@query("SELECT rel FROM (SELECT 'docs/' || (page_id % 7) || '/img/' || page_id AS rel, page_id FROM pages) WHERE page_id % 7 = 3 OR rel = 'docs/1/img/8'")
def copy_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = F.col("page_id")
    documents = table(spark, sf_dir, "pages").select(F.concat(F.lit("docs/"), (page % 7).cast("string"), F.lit("/img/"), page.cast("string")).alias("rel"))
    return J.copies(documents, ["3", "docs/1/img/8"])
