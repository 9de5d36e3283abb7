"""A run over many documents: which are due, and the report of what became of each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The lists of a run and the text before the names of lost parts.
ONLY = ("pdf", "office", "copy")
LOST = "LOST PARTS: "


def plan(documents: DataFrame, outputs: DataFrame, only: str | None = None, force: bool = False) -> DataFrame:
    """``documents`` (src, kind, mtime, ...) of a run, with due: whether there is no output (src, mtime) as new as the document.

    ``only`` is one of the lists or None for all. Kinds besides the lists belong to no run.
    """
    if only is not None and only not in ONLY:
        raise ValueError(f"only must be one of {', '.join(ONLY)}, not {only!r}")
    wanted = documents.where(F.col("kind").isin(*([only] if only else ONLY)))
    if force:
        return wanted.withColumn("due", F.lit(True))
    newest = outputs.groupBy(F.col("src").alias("__src__")).agg(F.max("mtime").alias("__out__"))
    met = wanted.join(newest, F.col("src") == F.col("__src__"), "left")
    return met.withColumn("due", ~F.coalesce(F.col("__out__") >= F.col("mtime"), F.lit(False))).drop("__src__", "__out__")


def corpus_report(planned: DataFrame, results: DataFrame) -> DataFrame:
    """Per planned document: kind, src, status - ok, copied, skipped or ERROR - and error.

    ``results`` (src, error, lost_parts) has a row for each document that was due; a due document without one has
    failed too. An office file that lost parts is ok but has their names as its error.
    """
    told = results.select(F.col("src").alias("__src__"), F.col("error").alias("__error__"), "lost_parts")
    met = planned.join(told, F.col("due") & (F.col("src") == F.col("__src__")), "left")
    error = F.when(F.col("due"), F.when(F.col("__src__").isNull(), "no result").otherwise(F.col("__error__")))
    good = F.when(F.col("kind") == "copy", "copied").otherwise("ok")
    status = F.when(~F.col("due"), "skipped").when(error.isNotNull(), "ERROR").otherwise(good)
    lost = F.when((F.col("kind") == "office") & F.col("due") & (F.size("lost_parts") > 0), F.concat(F.lit(LOST), F.array_join(F.array_sort("lost_parts"), ", ")))
    return met.select("kind", "src", status.alias("status"), F.coalesce(error, lost).alias("error"))


def errors(report: DataFrame) -> DataFrame:
    """(src, error) of a report's documents that failed or lost parts."""
    return report.where(F.col("error").isNotNull()).select("src", "error")
