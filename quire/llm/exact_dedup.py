"""Exact deduplication by skew-safe combining.

Equal texts are combined in three stages, each of which groups by the digest *and* the
whole text, so that a digest collision never joins two different texts:

1. local: rows of one input partition (the map side of the first aggregation);
2. salted: the partitions' winners, where the salt is the input partition's number, so
   a text that a third of all rows hold is spread over ``salts`` groups;
3. global: the salts' winners of a text - at most ``salts`` rows for any text.

Rows are then labelled through the digest alone: a digest that stands for one text needs
no second look at the text. Digests that stand for several texts are labelled by digest
and text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import staged


def sha256_digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def exact_dedup(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    salts: int = 64,
    digest: Callable[[Column], Column] = sha256_digest,
) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the largest id stays. Nulls: a null text equals the empty
    text; a null id is smaller than any id, and where all ids of a group are null, keep_id
    is null. Repeated rows (same id, same text) count in group_size; all rows that have the
    group's largest id are ``kept``, because they can't be told apart. Other columns are
    ignored. An empty table gives no rows.
    """
    text = F.coalesce(F.col(text_column), F.lit(""))
    rows = docs.select(F.col(id_column).alias("doc_id"), text.alias("text"), digest(text).alias("digest"))
    locally = rows.groupBy("digest", "text", (F.spark_partition_id() % salts).alias("salt"))
    by_salt = locally.agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
    # One exchange by digest serves both aggregations below.
    by_text = by_salt.repartition("digest").groupBy("digest", "text").agg(F.max("keep_id").alias("keep_id"), F.sum("n").alias("group_size"))
    by_digest = by_text.groupBy("digest").agg(
        F.count(F.lit(1)).alias("texts"),
        F.collect_list(F.when(F.col("group_size") > 1, F.struct("text", "keep_id", "group_size"))).alias("groups"),
    )
    several = staged(by_digest.where(F.size("groups") > 0), "exact-dedup")
    alone = several.where("texts = 1").select("digest", F.col("groups")[0]["keep_id"].alias("keep_id"), F.col("groups")[0]["group_size"].alias("group_size"))
    collided = several.where("texts > 1")
    if collided.isEmpty():
        labelled = rows.select("doc_id", "digest").join(alone, "digest", "left")
    else:
        of_text = collided.select("digest", F.explode("groups").alias("g")).select("digest", "g.*")
        digests = collided.select("digest")
        labelled = (
            rows.join(digests, "digest", "left_anti").join(alone, "digest", "left").drop("text")
            .unionByName(rows.join(digests, "digest", "left_semi").join(of_text, ["digest", "text"], "left").drop("text"))
        )
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return labelled.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )
