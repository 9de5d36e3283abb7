"""Shared helpers of the training-data operators.

Conventions that hold for every operator of this subpackage:

* only the input columns an operator names are read, so extra columns - also ones named
  like an output column - never clash with its results;
* a null text counts as the empty text;
* an empty table gives an empty result with the same schema.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.plans.staging import removed, shared_folder, staged

__all__ = ["removed", "shared_folder", "staged"]

#: Bytes that separate words, in every contract of this subpackage.
WHITE_SPACE = "\\x20\\x09-\\x0D"

#: Bits of a key filter, at most: 16 MB, whatever the number of keys.
FILTER_BITS = 1 << 27


class KeyFilter:
    """A bitmap of key hashes, of a bounded size, that says of a row that its key is surely none of ``keys``, or may be one.

    It saves the rows that are surely none from being shuffled to the keys; a join has the
    last word on the others. The more keys, the fewer rows it spares; with very many, all
    go the join's way.
    """

    def __init__(self, keys: DataFrame, columns: list[str], rows: int, most: int = FILTER_BITS):
        self.bits = min(most, max(1 << 15, 1 << (16 * rows).bit_length()))
        place = self._place([F.col(c) for c in columns])
        places = keys.select(place.alias("place"))
        self.bitmaps = staged(places.groupBy(F.bitmap_bucket_number("place").alias("__bucket__")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("__bitmap__")), "key-filter")

    def _place(self, columns: list[Column]) -> Column:
        return F.xxhash64(*columns).bitwiseAND(F.lit(self.bits - 1))

    def flagged(self, rows: DataFrame, columns: list[Column], into: str) -> DataFrame:
        """``rows`` with ``into``: whether the key may be one of the filter's."""
        place = rows.withColumn("__place__", self._place(columns))
        met = place.join(F.broadcast(self.bitmaps), F.bitmap_bucket_number("__place__") == F.col("__bucket__"), "left")
        at = F.bitmap_bit_position("__place__")
        byte = F.conv(F.hex(F.substring("__bitmap__", F.shiftright(at, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        hit = F.coalesce(F.getbit(byte, at.bitwiseAND(F.lit(7)).cast("int")) == 1, F.lit(False))
        return met.withColumn(into, hit).drop("__place__", "__bucket__", "__bitmap__")


def bounded_batches(df: DataFrame, rows: int = 2000) -> None:
    """Lowers Spark's default of 10,000 rows an Arrow batch, which tasks on whole texts hold several copies of; a smaller setting stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(df.sparkSession.conf.get(name)) > rows:
        df.sparkSession.conf.set(name, str(rows))


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def id_crc(column: str = "doc_id") -> Column:
    """crc32 of the id as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))


def fold_ascii(column: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def word_count(column: Column) -> Column:
    """Number of words ``[^\\x20\\x09-\\x0D]+``."""
    return F.regexp_count(column, F.lit(f"[^{WHITE_SPACE}]+")).cast("long")
