"""Numeric decisions of rendering: wrapping, fitting, fonts, edits and ink."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from quire.functions.fonts import BUNDLED_SUBSTITUTE, PLACEHOLDERS, SYSTEM_SUBSTITUTE, font_class, parse_font_name

# Least share of the original size, the step down, the stretch of justified spaces, and ink thresholds.
LEAST_SCALE, SIZE_STEP, MOST_STRETCH = 0.72, 0.25, 2.6
CHARACTER_WIDTH = 0.55
#: Font faces that are broadcast; more are joined by shuffling.
BROADCAST_FACES = 50_000
# What marks reach above and below a text, in shares of its size, and the slack at its sides in points.
HIGHLIGHT_RISE, HIGHLIGHT_DROP, UNDERLINE_OFFSET, UNDERLINE_THICKNESS, CLEAR_EPSILON = 0.80, 0.22, 0.12, 0.07, 0.75
DARK, LEAST_INK, LEAST_RUNS, BOLD_RATIO, FILL_PERCENTILE, MOST_NOISE = 165, 60, 20, 0.155, 0.82, 6.0


def line_starts(ends: np.ndarray, room: float, first_room: float) -> list[int]:
    """First word of each line of a text whose words end at ``ends`` characters, a blank after each; room is in characters too.

    A line holds all words up to the last that ends within its room, and one word at least.
    """
    starts, at, room_now = [], 0, first_room
    while at < len(ends):
        starts.append(at)
        begin = ends[at - 1] if at else 0
        at = max(at + 1, int(np.searchsorted(ends, begin + room_now + 1 + 1e-9, "right")))
        room_now = room
    return starts


def fit(text: str, size: float, room: float, height: float, leading: float, first_indent: float = 0.0, width: float = CHARACTER_WIDTH) -> tuple[float, float, int]:
    """(size, leading, lines): the largest of the allowed sizes at which the wrapped text is no higher than the room, or the least one.

    All widths grow with the size, so a size is a room in characters. The sizes are a ladder from the original down to
    its least share; height falls along it, so the place is found by halving.
    """
    ends = np.cumsum([len(word) + 1 for word in text.split()])
    if not len(ends):
        return size, leading, 1
    rungs = max(0, math.ceil(size * (1 - LEAST_SCALE) / SIZE_STEP - 1e-9))

    def at_rung(i: int) -> tuple[float, float, int]:
        now = max(size * LEAST_SCALE, size - SIZE_STEP * i)
        lines = len(line_starts(ends, room / (now * width), (room - first_indent) / (now * width)))
        return now, leading * now / size, lines

    def too_high(i: int) -> bool:
        now, lead, lines = at_rung(i)
        return (lines - 1) * lead + now > height

    return at_rung(_first(rungs, too_high))


def _first(rungs: int, too_high: Callable[[int], bool]) -> int:
    """The first rung that is not too high, or the last one."""
    low, high = 0, rungs
    while low < high:
        middle = (low + high) // 2
        low, high = (middle + 1, high) if too_high(middle) else (low, middle)
    return low


def natural_width(words: Sequence[str], size: float, width: float = CHARACTER_WIDTH) -> float:
    """Width of a line of words with a blank between two."""
    return width * size * (sum(map(len, words)) + max(0, len(words) - 1))


def fit_paragraphs(paras: DataFrame) -> DataFrame:
    """``paras`` (text, size, room, height, leading, first_indent) with fit_size, fit_leading, fit_lines, scaled, overflow."""
    added = [T.StructField("fit_size", T.DoubleType()), T.StructField("fit_leading", T.DoubleType()), T.StructField("fit_lines", T.IntegerType())]
    names = ["text", "size", "room", "height", "leading", "first_indent"]
    places = [paras.columns.index(n) for n in names]

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fit(text or "", *numbers) for text, *numbers in zip(*(batch.column(i).to_pylist() for i in places), strict=True)]
            columns = [pa.array([f[i] for f in found], to_arrow_type(field.dataType)) for i, field in enumerate(added)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*paras_columns, *(f.name for f in added)])

    paras_columns = paras.columns
    done = paras.mapInArrow(fitted, T.StructType([*paras.schema.fields, *added]))
    bottom = (F.col("fit_lines") - 1) * F.col("fit_leading") + F.col("fit_size")
    return done.withColumn("scaled", F.col("fit_size") < F.col("size")).withColumn("overflow", bottom > F.col("height"))


def line_facts(lines: DataFrame, room: str = "room") -> DataFrame:
    """``lines`` (words array, size, align, is_last, room) with natural_width, x_offset and space_width: what drawing a line needs.

    A justified line that is not the last stretches its blanks to the room, but not beyond the allowed share of a blank.
    """
    blank = F.col("size") * CHARACTER_WIDTH
    gaps = F.greatest(F.lit(0), F.size("words") - 1)
    letters = F.aggregate("words", F.lit(0), lambda n, w: n + F.length(w))
    natural = blank * (letters + gaps)
    free = F.col(room) - natural
    stretched = F.least(blank + free / F.greatest(F.lit(1), gaps), blank * MOST_STRETCH)
    justified = (F.col("align") == "justify") & ~F.col("is_last") & (gaps > 0) & (free > 0)
    offset = F.when(F.col("align") == "center", F.greatest(F.lit(0.0), free / 2)).when(F.col("align") == "right", F.greatest(F.lit(0.0), free)).otherwise(0.0)
    return lines.withColumn("natural_width", natural).withColumn("x_offset", offset).withColumn("space_width", F.when(justified, stretched).otherwise(blank))


def resolve_fonts(fonts: DataFrame, index: DataFrame, bundled: DataFrame, default_family: str | None = None) -> DataFrame:
    """``fonts`` (font) with resolved, path, bold, italic, substituted.

    ``index`` and ``bundled`` hold (family, bold, italic, path). In order: each candidate
    family of the name, the class's system substitute, its bundled one; within a family
    the exact style, then without italic, then without bold, plain, and any.
    """
    names, bold, italic = parse_font_name(F.col("font"))
    known = fonts.withColumn("bold", bold).withColumn("italic", italic).withColumn("names", names)
    placeholder = (F.size("names") == 0) | F.get("names", F.lit(0)).isin(PLACEHOLDERS)
    fallback = F.array(F.lit(default_family.lower())) if default_family else F.when(F.size("names") == 0, F.array(F.lit("arial"))).otherwise(F.col("names"))
    known = known.withColumn("names", F.when(placeholder, fallback).otherwise(F.col("names"))).withColumn("family", F.element_at("names", -1))
    kind = font_class(F.col("family"))
    substitute = lambda table: F.element_at(F.create_map(*(F.lit(x) for p in table.items() for x in p)), kind)
    tiers = F.transform("names", lambda n, i: F.struct(i.cast("int").alias("tier"), n.alias("name")))
    tiers = F.concat(tiers, F.array(F.struct(F.lit(100).alias("tier"), substitute(SYSTEM_SUBSTITUTE).alias("name")), F.struct(F.lit(200).alias("tier"), substitute(BUNDLED_SUBSTITUTE).alias("name"))))
    wanted = known.select("font", "bold", "italic", "family", F.explode(tiers).alias("t")).select("font", "bold", "italic", "family", "t.tier", "t.name")
    faces = index.withColumn("is_bundled", F.lit(False)).unionByName(bundled.withColumn("is_bundled", F.lit(True))).select(
        F.col("family").alias("name"), F.col("bold").alias("f_bold"), F.col("italic").alias("f_italic"), "path", "is_bundled"
    )
    faces = F.broadcast(faces) if faces.limit(BROADCAST_FACES + 1).count() <= BROADCAST_FACES else faces
    met = wanted.join(faces, "name").where(F.col("is_bundled") == (F.col("tier") == 200))
    b, i, fb, fi = (F.col(c) for c in ("bold", "italic", "f_bold", "f_italic"))
    style = F.when((fb == b) & (fi == i), 0).when((fb == b) & ~fi, 1).when(~fb & (fi == i), 2).when(~fb & ~fi, 3).otherwise(4)
    best = met.groupBy("font").agg(F.min(F.struct("tier", style.alias("style"), "path", "name")).alias("m"))
    joined = known.join(best, "font", "left")
    return joined.select(
        "font", F.coalesce("m.name", "family").alias("resolved"), F.col("m.path").alias("path"), "bold", "italic", (F.col("m.tier").isNull() | (F.col("m.tier") >= 100)).alias("substituted")
    )


def apply_edits(paras: DataFrame, edits: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``paras`` (keys, para, text) with final_text and action: edits are matched by place; what has none is kept."""
    edited = edits.select(*keys, "para", F.col("text").alias("new_text"), "deleted")
    met = paras.join(edited, [*keys, "para"], "left")
    action = F.when(F.col("deleted").isNull(), "kept").when(F.col("deleted"), "deleted").when(F.col("new_text") == F.col("text"), "kept").otherwise("modified")
    return met.withColumn("action", action).withColumn("final_text", F.when(F.col("action") == "modified", F.col("new_text")).when(F.col("action") == "kept", F.col("text"))).drop("new_text", "deleted")


def clear_rects(paras: DataFrame) -> DataFrame:
    """``paras`` (x0, y0, x1, y1, size) with clear_x0 to clear_y1: the box to clear before a paragraph is drawn anew, its marks included."""
    below = max(HIGHLIGHT_DROP, UNDERLINE_OFFSET + UNDERLINE_THICKNESS)
    return (
        paras.withColumn("clear_x0", F.col("x0") - CLEAR_EPSILON).withColumn("clear_x1", F.col("x1") + CLEAR_EPSILON)
        .withColumn("clear_y0", F.col("y0") - F.col("size") * HIGHLIGHT_RISE).withColumn("clear_y1", F.col("y1") + F.col("size") * below)
    )


def kept_runs(runs: Column) -> Column:
    """The runs of a paragraph that hold more than white space."""
    return F.filter(runs, lambda r: r["text"].rlike("\\S"))


def edited_rect(edit: Column, own: Column) -> Column:
    """The box of an edit, whose absent sides are those of the paragraph's own box."""
    return F.struct(*(F.coalesce(edit[side], own[side]).alias(side) for side in ("x0", "y0", "x1", "y1")))


def stem_ratios(pixels: DataFrame, keys: Sequence[str], size: Column, scale: float, dark: float = DARK) -> DataFrame:
    """Per box of pixels (keys, row, col, value): ink, runs and stem_ratio, the median length of dark horizontal runs by the type's size in pixels.

    Null where there is too little ink or are too few runs.
    """
    inked = pixels.where(F.col("value") < dark)
    island = F.col("col") - F.row_number().over(Window.partitionBy(*keys, "row").orderBy("col"))
    runs = inked.withColumn("island", island).groupBy(*keys, "row", "island").agg(F.count(F.lit(1)).alias("run"), F.first(size).alias("type_size"))
    found = runs.groupBy(*keys).agg(F.sum("run").alias("ink"), F.count(F.lit(1)).alias("runs"), F.median("run").alias("middle"), F.first("type_size").alias("type_size"))
    ratio = F.when((F.col("ink") >= LEAST_INK) & (F.col("runs") >= LEAST_RUNS), F.col("middle") / (F.col("type_size") * scale))
    return found.select(*keys, "ink", "runs", ratio.alias("stem_ratio"), F.coalesce(ratio >= BOLD_RATIO, F.lit(False)).alias("is_bold"))


def bullet_ink(pixels: DataFrame, keys: Sequence[str], rows: int, dark: float = DARK, least: int = 12) -> DataFrame:
    """Per gutter of pixels: ink and starts_item - some ink, but not a rule that runs through nine tenths of the rows."""
    found = pixels.groupBy(*keys).agg(F.count_if(F.col("value") < dark).alias("ink"), F.count_distinct(F.when(F.col("value") < dark, F.col("row"))).alias("inked_rows"))
    return found.withColumn("starts_item", (F.col("ink") >= least) & (F.col("inked_rows") < 0.9 * rows))


def fill_values(pixels: DataFrame, keys: Sequence[str], percentile: float = FILL_PERCENTILE) -> DataFrame:
    """Per box: paper value at the percentile, and its noise, capped."""
    paper = F.percentile("value", F.lit(percentile))
    found = pixels.groupBy(*keys).agg(paper.alias("fill"), F.stddev_pop("value").alias("spread"))
    return found.select(*keys, "fill", F.least("spread", F.lit(MOST_NOISE)).alias("noise"))


def comparison_sheet(tiles: DataFrame) -> DataFrame:
    """Size of a sheet of side-by-side tiles (width_a, height_a, width_b, height_b)."""
    w, h = F.col("width_a") + F.col("width_b") + 18, F.greatest("height_a", "height_b") + 26
    return tiles.agg(F.max(w).alias("sheet_width"), (F.sum(h) + 10 * (F.count(F.lit(1)) - 1)).alias("sheet_height"))


def dual_manifest(source: DataFrame, translated: DataFrame) -> DataFrame:
    """Pages (doc_id, page_no) of both sides interleaved, as many pairs as the shorter has: doc_id, position, side, page_no."""
    both = source.join(translated, ["doc_id", "page_no"])
    sides = F.explode(F.array(F.struct(F.lit(0).alias("n"), F.lit("source").alias("side")), F.struct(F.lit(1).alias("n"), F.lit("translated").alias("side"))))
    return both.select("doc_id", "page_no", sides.alias("s")).select("doc_id", (2 * F.col("page_no") + F.col("s.n")).alias("position"), "s.side", "page_no")
