"""Documents, jobs and uploads as state tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Limits of uploads and the first bytes of each allowed kind.
MOST_BYTES, MOST_PAGES = 50 * 1024 * 1024, 500
MAGIC = {".pdf": "255044462D", ".docx": "504B0304", ".pptx": "504B0304", ".xlsx": "504B0304", ".xls": "D0CF11E0A1B11AE1"}
LEAST_CHARS = 40
OCR_FONT = "GlyphLess"
OPEN = ("queued", "running")


def classify_documents(pages: DataFrame, keys: list[str]) -> DataFrame:
    """Per document of pages (text, fonts - an array): digital, scan or ocr.

    Too few characters a page is a scan; a text layer in the OCR's font alone is ocr. A
    document without pages is digital.
    """
    found = pages.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("pages"), F.sum(F.length(F.trim("text"))).alias("chars"), F.sum(F.size("fonts")).alias("fonts"), F.bool_and(F.forall("fonts", lambda f: F.contains(f, F.lit(OCR_FONT)))).alias("all_ocr")
    )
    kind = F.when((F.col("pages") > 0) & (F.col("chars") < LEAST_CHARS * F.col("pages")), "scan").when((F.col("fonts") > 0) & F.col("all_ocr"), "ocr").otherwise("digital")
    return found.select(*keys, "pages", "chars", kind.alias("kind"))


def up_to_date(sources: DataFrame, outputs: DataFrame, key: str = "rel") -> DataFrame:
    """Sources (rel, mtime) that have to be processed: their output is missing or older."""
    fresh = outputs.select(F.col(key).alias("__key__"), F.col("mtime").alias("__out__"))
    return sources.join(fresh, (F.col(key) == F.col("__key__")) & (F.col("__out__") >= F.col("mtime")), "left_anti")


def scan_last(documents: DataFrame, position: str) -> DataFrame:
    """Documents with their place in a run: digital ones first, those that scan or can't be classified last, each in order."""
    return documents.orderBy(F.coalesce(F.col("kind") != "digital", F.lit(True)), position)


def rejection(name: Column, head: Column, size: Column, pages: Column, most_bytes: int = MOST_BYTES) -> Column:
    """Why an upload is refused, the first reason in the order of the checks; null if it is accepted. ``head`` holds the first bytes as hex."""
    extension = F.lower(F.regexp_extract(name, "(\\.[^.]*)$", 1))
    bad_name = name.isNull() | name.isin("", ".", "..") | name.contains("/") | name.contains("\x00")
    magic = F.element_at(F.create_map(*(F.lit(x) for p in MAGIC.items() for x in p)), extension)
    return (
        F.when(bad_name, "invalid filename").when(~extension.isin(list(MAGIC)), "unsupported file type").when(size == 0, "empty file")
        .when(size > most_bytes, "file too large").when(~F.startswith(head, magic), "content does not match").when((extension == ".pdf") & (pages > MOST_PAGES), "too many pages")
    )


def job_status(files: DataFrame, jobs: DataFrame) -> DataFrame:
    """Per job: cancelled if it was, else failed if a file failed, else done."""
    by_job = files.groupBy("job_id").agg(F.bool_or(F.col("status") == "failed").alias("any_failed"))
    met = jobs.join(by_job, "job_id", "left")
    return met.select("job_id", F.when(F.col("cancelled"), "cancelled").when(F.coalesce("any_failed", F.lit(False)), "failed").otherwise("done").alias("status"))


def recovered(jobs: DataFrame) -> DataFrame:
    """Jobs after a restart: those that were open have failed."""
    return jobs.withColumn("status", F.when(F.col("status").isin(*OPEN), "failed").otherwise(F.col("status")))


def cancelled(jobs: DataFrame, job_id: int, visitor: str) -> DataFrame:
    """Jobs after a cancellation, which only an open job's own visitor can ask for."""
    mine = (F.col("job_id") == job_id) & (F.col("visitor_id") == visitor) & F.col("status").isin(*OPEN)
    return jobs.withColumn("status", F.when(mine, "cancelled").otherwise(F.col("status")))


def active_jobs(jobs: DataFrame) -> DataFrame:
    """Open jobs of each visitor."""
    return jobs.where(F.col("status").isin(*OPEN)).groupBy("visitor_id").agg(F.count(F.lit(1)).alias("active"))


def within_limit(jobs: DataFrame, limit: int = 1) -> DataFrame:
    return active_jobs(jobs).withColumn("may_start", F.col("active") < limit)


def copies(documents: DataFrame, copied: list[str]) -> DataFrame:
    """Documents (rel) that are copied as they are: their path, or a folder of it at any depth, is listed."""
    parts = F.split("rel", "/")
    return documents.where(F.col("rel").isin(copied) | F.exists(F.slice(parts, 1, F.greatest(F.lit(0), F.size(parts) - 1)), lambda p: p.isin(copied)))
