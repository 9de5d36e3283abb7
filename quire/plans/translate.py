"""The translation plan: documents to lines, units, translations and a report per document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import ordinals
from quire.functions.text import clean_lines, is_prose_line
from quire.operators import entities as E
from quire.operators import resolve as R
from quire.operators.backends import Backend, Context
from quire.plans.staging import staged

LINES_PER_PAGE = 40


def lines_of(documents: DataFrame) -> DataFrame:
    """(doc_id, line_no, page_no, line): the lines of each document; a page is 40 of them."""
    lines = documents.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line_no", "line"))
    return lines.select("doc_id", "line_no", F.floor(F.col("line_no") / LINES_PER_PAGE).cast("int").alias("page_no"), "line")


def units_of(documents: DataFrame) -> DataFrame:
    """(doc_id, line_no, page_no, unit): the prose lines, cleaned."""
    lines = documents.select("doc_id", F.posexplode(clean_lines(F.col("text"))).alias("line_no", "unit")).where(is_prose_line(F.col("unit")))
    return lines.select("doc_id", "line_no", F.floor(F.col("line_no") / LINES_PER_PAGE).cast("int").alias("page_no"), "unit")


def text_hash(text: Column) -> Column:
    """28 bits of a text's MD5, for choices that other engines can repeat."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 7), 16, 10).cast("long")


def translate_documents(
    documents: DataFrame, backend: Backend, context: Context, glossary: DataFrame, cache: DataFrame, rules: list[tuple[str, str]] = []
) -> tuple[DataFrame, DataFrame]:
    """(units with their translation, distinct translations), the backend being called once for each distinct remainder.

    The final units - prefixes split off, guarded texts aside - are made first and reduced
    to distinct ones, so neither a prefix nor a repeated line costs a call. The units are
    staged once they are final, and so are the distinct translations before units join them.
    """
    units = units_of(documents)
    guarded = E.is_guarded(F.col("unit"), context.entities)
    prefix, rest = ordinals.split_prefix(F.col("unit"))
    units = units.withColumn("guarded", guarded).withColumn("prefix", F.when(guarded, "").otherwise(prefix)).withColumn("rest", F.when(guarded, F.col("unit")).otherwise(rest))
    units = staged(units, "units")
    distinct = R.distinct_units(units.where("rest <> ''"), "rest").select("unit")
    done = staged(R.translate_units(distinct, backend, context, glossary, cache, rules), "translations")
    met = units.join(done.withColumnRenamed("unit", "rest"), "rest", "left")
    alone = F.col("rest") == ""
    en = F.when(alone, F.trim("prefix")).when(F.col("status") == "ok", F.concat("prefix", "en"))
    full = met.select(
        "doc_id", "line_no", "page_no", "unit", F.when(alone, "prefix").when(F.col("guarded"), "protected").otherwise(F.col("via")).alias("via"),
        F.when(alone, "ok").otherwise(F.col("status")).alias("status"), en.alias("translated"),
    )
    return full, done


def new_cache_entries(done: DataFrame, namespace: str) -> DataFrame:
    """Cache rows of backend results; protected and glossary texts are never cached."""
    return done.where("via = 'backend'").select(F.lit(namespace).alias("namespace"), F.col("unit").alias("source"), "en", "status")
