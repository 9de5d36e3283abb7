"""Document trees as JSON: reading with defaults, and writing."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.functions.text import page_numbers

# Fixed value: dots per inch of a page's picture.
PREVIEW_DOTS = 110
RECT = "struct<x0:double,y0:double,x1:double,y1:double>"
RUN = "struct<text:string,font:string,size:double,bold:boolean,italic:boolean,color:array<double>,underline:boolean,highlight:array<double>>"
PARAGRAPH = (
    f"struct<text:string,runs:array<{RUN}>,rect:{RECT},origin_x:double,origin_y:double,align:string,leading:double,size:double,font:string,"
    f"color:array<double>,indent:double,hang_x0:double,starts_item:boolean,clip:{RECT}>"
)
PAGE = f"struct<number:int,width:double,height:double,paragraphs:array<{PARAGRAPH}>>"
DOCUMENT = f"struct<source:string,pages:array<{PAGE}>>"


def parse_document(value: Column) -> Column:
    return F.from_json(value, DOCUMENT)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """One row per paragraph of document JSON files: source, page_no, width, height, para_no and the paragraph's fields, absent ones defaulted."""
    return paragraphs(spark.read.option("wholetext", True).text(path))


def paragraphs(documents: DataFrame) -> DataFrame:
    """As ``read_documents``, of rows (value)."""
    pages = documents.select(parse_document(F.col("value")).alias("d")).select("d.source", F.explode("d.pages").alias("p"))
    rows = pages.select("source", F.col("p.number").alias("page_no"), "p.width", "p.height", F.posexplode("p.paragraphs").alias("para_no", "q"))
    return rows.select(
        "source", "page_no", "width", "height", "para_no", "q.text", F.coalesce("q.runs", F.array().cast(f"array<{RUN}>")).alias("runs"), "q.rect", "q.origin_x", "q.origin_y",
        F.coalesce("q.align", F.lit("left")).alias("align"), "q.leading", "q.size", "q.font", F.coalesce("q.color", F.array(*[F.lit(0.0)] * 3)).alias("color"),
        F.coalesce("q.indent", F.lit(0.0)).alias("indent"), "q.hang_x0", F.coalesce("q.starts_item", F.lit(False)).alias("starts_item"), "q.clip",
    )


def _pages(rows: DataFrame) -> DataFrame:
    """(source, page): the pages of paragraph rows."""
    fields = ["text", "runs", "rect", "origin_x", "origin_y", "align", "leading", "size", "font", "color", "indent", "hang_x0", "starts_item", "clip"]
    held = F.transform(F.array_sort(F.collect_list(F.struct("para_no", F.struct(*fields).alias("q")))), lambda x: x["q"])
    pages = rows.groupBy("source", "page_no", "width", "height").agg(held.alias("paragraphs"))
    return pages.select("source", F.struct(F.col("page_no").alias("number"), "width", "height", "paragraphs").alias("page"))


def to_documents(rows: DataFrame) -> DataFrame:
    """(source, value): the document JSON of paragraph rows; a document is one row, as it is one file."""
    documents = _pages(rows).groupBy("source").agg(F.array_sort(F.collect_list("page")).alias("pages"))
    return documents.select("source", F.to_json(F.struct("source", "pages")).alias("value"))


def layout_envelopes(rows: DataFrame, dots: int = PREVIEW_DOTS) -> DataFrame:
    """(source, page_no, value): per page the JSON that an editor lays over the page's picture, with the picture's size in pixels."""
    zoom = dots / 72
    size = F.struct(F.col("page.number").alias("number"), *(F.bround(F.col(f"page.{side}") * zoom).cast("int").alias(f"px_{side}") for side in ("width", "height")))
    render = F.struct(F.lit(zoom).alias("zoom"), F.array(size).alias("pages"))
    value = F.to_json(F.struct(F.lit(1).alias("schema"), "source", F.array("page").alias("pages"), render.alias("render")))
    return _pages(rows).select("source", F.col("page.number").alias("page_no"), value.alias("value"))


def marked_pages(pages: DataFrame, numbers: str | None, page: str = "page_no") -> DataFrame:
    """``pages`` with selected: whether the page is among the numbers asked for; the others stay as they are. None selects all."""
    return pages.withColumn("selected", F.lit(True) if numbers is None else F.array_contains(page_numbers(F.lit(numbers)), F.col(page)))


@F.pandas_udf(T.StringType())
def composed(text: pd.Series) -> pd.Series:
    """Canonical composition, which Spark has no function for."""
    return text.map(lambda s: None if s is None else unicodedata.normalize("NFC", s))
