"""Resumable translation of arriving documents: a file stream whose batches go through the batch plan and its cache."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quire.operators import cache as C
from quire.operators.backends import Backend, Context
from quire.plans.translate import new_cache_entries, translate_documents

DOCUMENT_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def translate_stream(
    spark: SparkSession, arriving: str, output: str, cache_path: str, checkpoint: str, backend: Backend, context: Context, glossary: DataFrame, namespace: str,
    rules: list[tuple[str, str]] = [],
) -> StreamingQuery:
    """Translates Parquet files of documents as they arrive.

    Each batch writes to a folder of its own number, so a batch that is run again after a
    failure replaces its output; what an earlier batch translated answers from the cache.
    """

    def batch(documents: DataFrame, number: int) -> None:
        log = spark.read.schema("namespace string, source string, en string, status string, seq long").parquet(cache_path)
        known = C.upsert_latest(log.where((F.col("namespace") == namespace) & (F.col("seq") < number)))
        units, done = translate_documents(documents, backend, context, glossary, known, rules)
        units.write.mode("overwrite").parquet(f"{output}/batch={number}")
        entries = new_cache_entries(done, namespace).withColumn("seq", F.lit(number).cast("long"))
        entries.write.mode("overwrite").parquet(f"{cache_path}/part={number}")

    stream = spark.readStream.schema(DOCUMENT_SCHEMA).parquet(arriving)
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
