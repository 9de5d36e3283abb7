"""Mixing sources to target weights along a time-varying curriculum.

Every source has a weight schedule over the training run, time 0 to 1: a list of weights
at evenly spaced times, linear between them. Its integral up to t, as a share of the whole
integral, is the part of the source's target that training has taken by t. A document's
words stand at cumulative places within its source, in a fixed pseudo-random order;
inverting the integral at its place gives the document's training position, and documents
are range-sorted by position.

Plan: (1) sizes are counted once and staged without texts; (2) sources and their buckets -
ranges of the pseudo-random order, of a bounded number of rows and words each - are summed
with map-side combining; (3) prefix sums over a source's *buckets* give each bucket's
first place; (4) documents meet their bucket's first place in a join on (source, bucket),
and a window within the bucket gives their own place. No task ever holds a source.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import staged, text_or_empty, word_count

#: Fixed values of the contract: weights by rank of the source, share of all words, and times a source may be used.
WEIGHTS, SHARE, EPOCHS = (5.0, 2.0, 1.0), 1.5, 2
#: Weight schedules by rank of the source, repeating: at even times from 0 to 1.
SCHEDULES = ((1.0, 1.0, 1.0), (1.5, 1.0, 0.5), (0.5, 1.0, 1.5))
#: A bucket holds about so many rows and words.
BUCKET_ROWS, BUCKET_WORDS = 2_000, 2_000_000


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """Per source of ``sizes`` (source, size): rows, source_size, rank, target.

    The shares are those of water-filling: with sources in order of limit / weight, those
    before the water level get their limit and the others the level times their weight,
    which is what resharing any excess by weight ends at. Sources are ranked by code
    point, null last. Only the table of sources is windowed as a whole.
    """
    by_source = sizes.groupBy("source").agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("source_size"))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = by_source.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    limited = ranked.withColumn("weight", weight).withColumn("most", F.col("source_size") * float(epochs)).withColumn("level", F.col("most") / F.col("weight"))
    up_to = Window.orderBy("level", "rank").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    filled = (
        limited.withColumn("total", F.sum("source_size").over(everything) * share)
        .withColumn("used", F.coalesce(F.sum("most").over(up_to), F.lit(0.0)))
        .withColumn("rest", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(up_to), F.lit(0.0)))
        .withColumn("own_level", (F.col("total") - F.col("used")) / F.col("rest"))
        .withColumn("level_found", F.min(F.when(F.col("own_level") <= F.col("level"), F.struct("level", "rank", "own_level"))).over(everything)["own_level"])
    )
    target = F.least("most", F.coalesce(F.col("level_found") * F.col("weight"), F.col("most")))
    return filled.select("source", "rows", "source_size", F.col("rank").cast("long").alias("rank"), target.alias("target"))


def _position(share: Column, rank: Column, schedules: Sequence[Sequence[float]]) -> Column:
    """Inverse of each schedule's integral at a share of it, in closed form for each linear piece."""

    def inverse(weights: Sequence[float]) -> Column:
        step = 1.0 / (len(weights) - 1)
        areas = [(a + b) / 2 * step for a, b in zip(weights, weights[1:], strict=False)]
        whole, before, found = sum(areas), 0.0, F.lit(1.0)
        pieces = []
        for i, (area, a, b) in enumerate(zip(areas, weights, weights[1:], strict=False)):
            left, slope = share * whole - before, (b - a) / step
            inside = left / a if not slope else (F.sqrt(F.greatest(F.lit(0.0), a * a + 2 * slope * left)) - a) / slope
            pieces.append((before + area, i * step + inside))
            before += area
        for end, at in reversed(pieces):
            found = F.when(share * whole <= end, at).otherwise(found)
        return F.least(F.lit(1.0), F.greatest(F.lit(0.0), found))

    out = inverse(schedules[0])
    for i, weights in enumerate(schedules[1:], 1):
        out = F.when(rank % len(schedules) == i, inverse(weights)).otherwise(out)
    return out


def curriculum(
    rows: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    share: float = SHARE,
    epochs: int = EPOCHS,
    schedules: Sequence[Sequence[float]] = SCHEDULES,
    sizes: DataFrame | None = None,
) -> DataFrame:
    """``rows`` (doc_id, source, size, key, and whatever is carried along) with source_size, target, takes and positions.

    ``takes`` is an array of the words taken by each use of the document, up to ``epochs``
    of them; a source's takes add up to its target, rounded. All are whole documents but
    the one in which the target ends, of which the first words are taken. ``positions``
    are the uses' training positions. ``sizes`` may give the plain (doc_id, source, size, key)
    of the same rows, so that texts carried along are read once.
    """
    sizes = rows.select("doc_id", "source", "size", "key") if sizes is None else sizes
    targets = staged(source_targets(sizes, weights, share, epochs), "mix-targets")
    parts = F.greatest(F.lit(1), F.ceil(F.col("rows") / BUCKET_ROWS), F.ceil(F.col("source_size") / BUCKET_WORDS)).cast("long")
    # Few sources, one row each: what a row needs of its source before it can be dealt out is its number of buckets.
    by_rank = targets.select(F.col("source").alias("of"), parts.alias("buckets"))

    def dealt(frame: DataFrame) -> DataFrame:
        keyed = frame.join(by_rank, F.col("source").eqNullSafe(F.col("of")), "left").drop("of")
        at = F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * F.col("buckets")
        return keyed.withColumn("bucket", F.shiftright(at, 32)).drop("buckets")

    bucket_sizes = dealt(sizes).groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = bucket_sizes.withColumn("first", F.coalesce(F.sum("bucket_size").over(before), F.lit(0)))
    first = first.join(targets.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).select(
        F.col("source").alias("of_source"), F.col("bucket").alias("of_bucket"), "first", "source_size", "target", "rank"
    )
    met = dealt(rows).join(first, F.col("source").eqNullSafe(F.col("of_source")) & (F.col("bucket") == F.col("of_bucket")))
    within = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("first") + F.coalesce(F.sum("size").over(within), F.lit(0))
    end = F.round("target").cast("long")
    placed = met.withColumn("start", start)
    uses = [F.col("start") + F.col("source_size") * F.lit(epoch) for epoch in range(epochs)]
    takes = F.array(*(F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), end - use)) for use in uses))
    positions = F.array(*(_position(F.least(F.lit(1.0), use / F.greatest(F.col("target"), F.lit(1.0))), F.col("rank"), schedules) for use in uses))
    return placed.withColumn("takes", takes).withColumn("positions", positions).drop("key", "bucket", "first", "start", "of_source", "of_bucket", "rank")


def order_key(id_column: str = "doc_id", text_column: str = "text") -> Column:
    """Pseudo-random order of documents. The text is part of it, so that rows without an id, or with one for all, don't fall into one bucket."""
    return F.md5(F.concat(F.coalesce(F.col(id_column).cast("string"), F.lit("")), F.lit(":"), text_or_empty(text_column)).cast("binary"))


def sized(docs: DataFrame, id_column: str = "doc_id", source_column: str = "source", text_column: str = "text") -> DataFrame:
    return docs.select(F.col(id_column).alias("doc_id"), F.col(source_column).alias("source"), word_count(text_or_empty(text_column)).alias("size"), order_key(id_column, text_column).alias("key"))


def mix(docs: DataFrame, **settings) -> DataFrame:
    """One row per input row: doc_id, size, source_size, target, taken, position; range-sorted by position.

    Nulls: a null text has no words; null sources are one source, the last; a null id is
    ordered like an empty one. Repeated rows are rows like any other. Documents without
    words, and those the target does not reach, take 0 words and have a null position,
    after all others. Other columns are ignored; an empty table gives no rows.
    """
    sizes = staged(sized(docs), "mix-sizes")
    placed = curriculum(sizes, sizes=sizes, **settings)
    taken = F.aggregate("takes", F.lit(0).cast("long"), lambda a, b: a + b)
    position = F.when(F.col("takes")[0] > 0, F.round(F.col("positions")[0], 9))
    out = placed.select("doc_id", "size", "source_size", "target", taken.alias("taken"), position.alias("position"))
    return out.orderBy(F.col("position").asc_nulls_last(), "doc_id")


def mixed(docs: DataFrame, **settings) -> DataFrame:
    """The training order: the rows of ``docs``, with their columns, once for each use, range-sorted by training position.

    A use is a whole document or nothing: the one in which a source's target ends is used
    if at least half of it lies before the end. Nulls, repeated rows and empty tables are
    as in ``mix``; documents without words are not used; texts of any length are one row.
    """
    sizes = staged(sized(docs), "mix-sizes")
    rows = docs.select(F.col("doc_id").alias("doc_id"), F.col("source").alias("source"), word_count(text_or_empty()).alias("size"), order_key().alias("key"), F.struct("*").alias("__row__"))
    placed = curriculum(rows, sizes=sizes, **settings)
    uses = F.filter(F.arrays_zip("takes", "positions"), lambda use: (use["takes"] > 0) & (2 * use["takes"] >= F.col("size")))
    used = placed.select("__row__", F.explode(uses).alias("use")).select("__row__", F.col("use.positions").alias("at"))
    ordered = used.repartitionByRange(F.col("at"), F.col("__row__.doc_id")).sortWithinPartitions("at", "__row__.doc_id")
    return ordered.select("__row__.*")
