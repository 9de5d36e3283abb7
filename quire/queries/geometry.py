"""Queries over layout, runs, rendering and ink."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import ordinals
from quire.operators import layout as L
from quire.operators import render as D
from quire.operators import resolve as R
from quire.plans.translate import text_hash
from quire.queries import query, table
from quire.queries.common import CASED, LINES, OPENED, cased, opened

PAGE = ["doc_id", "page_no"]
GEOMETRY = OPENED + """, g AS (
  SELECT doc_id, page_no, line_no, unit AS text, 50.0::DOUBLE + CASE WHEN line_no % 5 = 1 THEN 15 ELSE 0 END AS x0, 14.0::DOUBLE * (line_no % 40) + CASE WHEN line_no % 7 = 0 THEN 10 ELSE 0 END AS y0,
    11.0::DOUBLE + CASE WHEN line_no % 11 = 0 THEN 1 ELSE 0 END AS size, length(unit) AS n FROM opened
), lined AS (SELECT *, x0 + 0.55::DOUBLE * size * n AS x1, y0 + 12 AS y1 FROM g)"""
GROUPED = GEOMETRY + r""", stepped AS (
  SELECT *, y0 - lag(y1) OVER o AS gap, lag(size) OVER o AS before_size, lag(x0) OVER o AS before_x0, row_number() OVER o = 1 AS is_first, min(x0) OVER b AS margin, median(size) OVER b AS typical_size
  FROM lined WINDOW o AS (PARTITION BY doc_id, page_no ORDER BY y0, x0, line_no), b AS (PARTITION BY doc_id, page_no)
), typed AS (SELECT *, coalesce(median(CASE WHEN gap > -5 THEN gap END) OVER (PARTITION BY doc_id, page_no), 0) AS typical FROM stepped),
marked AS (
  SELECT *, regexp_matches(text, '^\s*(?:[a-zA-Z]\)|\(?[ivxIVX]{1,4}\)|\d{1,2}[.)]|[•●○◦▪§·]|[-–—]\s)\s*') AS marker, coalesce(x0 <= margin + 1 AND before_x0 > margin + 8, false) AS returns_,
    coalesce(gap > greatest(typical + 0.6 * typical_size, typical * 1.8 + 1.0) OR abs(before_size - size) > 0.6, false) AS stepped_, regexp_matches(text, '(?i)^(?:ORDINALS)[.,:\s]') AS heading FROM typed
), itemed AS (
  SELECT *, last_value(CASE WHEN marker OR stepped_ OR heading OR returns_ OR is_first THEN marker END IGNORE NULLS) OVER (PARTITION BY doc_id, page_no ORDER BY y0, x0, line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS item FROM marked
), broken AS (
  SELECT *, CASE WHEN is_first THEN 0 WHEN marker OR stepped_ OR heading OR (coalesce(lag(item) OVER o, false) AND returns_) THEN 1 ELSE 0 END AS breaks FROM itemed
  WINDOW o AS (PARTITION BY doc_id, page_no ORDER BY y0, x0, line_no)
), grouped AS (SELECT *, CAST(sum(breaks) OVER (PARTITION BY doc_id, page_no ORDER BY y0, x0, line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS para FROM broken)""".replace("ORDINALS", ordinals.ALTERNATIVES)


def lined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with the derived geometry."""
    place = F.col("line_no")
    rows = opened(spark, sf_dir).select(
        *PAGE, "line_no", F.col("unit").alias("text"), (50.0 + 15 * (place % 5 == 1).cast("int")).alias("x0"), (14.0 * (place % 40) + 10 * (place % 7 == 0).cast("int")).alias("y0"), (11.0 + (place % 11 == 0).cast("int")).alias("size")
    )
    return rows.withColumn("x1", F.col("x0") + 0.55 * F.col("size") * F.length("text")).withColumn("y1", F.col("y0") + 12)


def grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.group_lines(lined(spark, sf_dir), PAGE)


@query(f"WITH {GROUPED} SELECT doc_id, page_no, line_no, para FROM grouped")
def layout_group_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouped(spark, sf_dir).select(*PAGE, "line_no", "para")


@query(f"WITH {GEOMETRY} SELECT doc_id, page_no, line_no, CAST(row_number() OVER (PARTITION BY doc_id, page_no ORDER BY y0, x0, line_no) AS INT) AS position FROM lined")
def reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.reading_order(lined(spark, sf_dir), PAGE).select(*PAGE, "line_no", "position")


@query(f"""WITH {GROUPED}, numbered AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page_no, para ORDER BY y0 DESC, x0 DESC, line_no DESC) = 1 AS is_last, count(*) OVER (PARTITION BY doc_id, page_no, para) AS n_lines FROM grouped),
found AS (SELECT doc_id, page_no, para, count(*) AS lines, min(x0) AS left_most, max(x0) - min(x0) AS lefts, max(CASE WHEN NOT is_last OR n_lines <= 2 THEN x1 END) - min(CASE WHEN NOT is_last OR n_lines <= 2 THEN x1 END) AS rights,
  max((x0 + x1) / 2) - min((x0 + x1) / 2) AS centres, min(x0) - 50.0 AS lg, 550.0 - max(x1) AS rg, arg_min(x0, y0 * 1000000 + x0) AS first_x0 FROM numbered GROUP BY doc_id, page_no, para)
SELECT doc_id, page_no, para, lines, first_x0 - left_most AS indent, CASE WHEN lines = 1 THEN CASE WHEN lg > 6 AND abs(lg - rg) < greatest(2.0, 0.18 * greatest(lg, rg)) THEN 'center' WHEN lg > 6 AND rg <= 2 THEN 'right' ELSE 'left' END
  WHEN lefts <= 2 AND rights <= 2 THEN 'justify' WHEN lefts <= 2 THEN 'left' WHEN rights <= 2 THEN 'right' WHEN centres <= 3 THEN 'center' ELSE 'left' END AS align FROM found""")
def layout_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = grouped(spark, sf_dir).withColumn("block_x0", F.lit(50.0)).withColumn("block_x1", F.lit(550.0))
    return L.alignment(lines, [*PAGE, "para"])


@query(f"""WITH {GROUPED}, steps AS (SELECT *, y1 - lag(y1) OVER (PARTITION BY doc_id, page_no, para ORDER BY y0, x0, line_no) AS step FROM grouped)
SELECT doc_id, page_no, para, median(CASE WHEN step > 0 AND step < 200 THEN step END) AS leading FROM steps GROUP BY doc_id, page_no, para""")
def layout_leading(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.leading(grouped(spark, sf_dir), [*PAGE, "para"])


def _celled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines, every fourth of which is a cell beside the line above."""
    cell = F.col("line_no") % 4 == 3
    return lined(spark, sf_dir).withColumn("y0", F.when(cell, F.col("y0") - 14).otherwise(F.col("y0"))).withColumn("y1", F.col("y0") + 12).withColumn("x0", F.when(cell, 330.0).otherwise(F.col("x0"))).withColumn(
        "x1", F.col("x0") + F.least(F.col("x1") - F.col("x0"), F.lit(250.0))
    )


CELLED = GEOMETRY + """, celled AS (
  SELECT doc_id, page_no, line_no, text, size, c0 AS x0, r0 AS y0, c0 + least(x1 - c0, 250.0) AS x1, r0 + 12 AS y1
  FROM (SELECT *, CASE WHEN line_no % 4 = 3 THEN 330.0::DOUBLE ELSE x0 END AS c0, CASE WHEN line_no % 4 = 3 THEN y0 - 14 ELSE y0 END AS r0 FROM lined)
)"""


def _first_fit(name: str, source: str, order: str, low: str, high: str, share: float) -> str:
    """SQL of the greedy grouping of a page's extents, line by line: ``name`` (doc_id, page_no, line_no, grp)."""
    return f"""{name}_placed AS (
  SELECT doc_id, page_no, line_no, {low} AS lo, {high} AS hi, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY {order}, line_no) AS place FROM {source}
), {name}_folded AS (
  SELECT doc_id, page_no, 0::BIGINT AS place, CAST(NULL AS INT) AS line_no, CAST([] AS STRUCT(lo DOUBLE, hi DOUBLE)[]) AS groups, CAST(NULL AS INT) AS grp FROM {name}_placed GROUP BY doc_id, page_no
  UNION ALL
  SELECT doc_id, page_no, place, line_no, CASE WHEN spot IS NULL THEN list_append(groups, struct_pack(lo := lo, hi := hi))
    ELSE list_transform(groups, lambda g, i: CASE WHEN i = spot THEN struct_pack(lo := least(g.lo, lo), hi := greatest(g.hi, hi)) ELSE g END) END, CAST(coalesce(spot, len(groups) + 1) - 1 AS INT)
  FROM (SELECT p.*, f.groups, list_filter(range(1, len(f.groups) + 1), lambda i: least(p.hi, f.groups[i].hi) - greatest(p.lo, f.groups[i].lo)
      > {share} * least(p.hi - p.lo, CASE WHEN f.groups[i].hi = f.groups[i].lo THEN 1.0 ELSE f.groups[i].hi - f.groups[i].lo END))[1] AS spot
    FROM {name}_folded f JOIN {name}_placed p ON p.doc_id = f.doc_id AND p.page_no = f.page_no AND p.place = f.place + 1)
), {name} AS (SELECT doc_id, page_no, line_no, grp FROM {name}_folded WHERE line_no IS NOT NULL)"""


ROWS_SQL = CELLED + ", " + _first_fit("placed_rows", "celled", "y0", "y0", "y1", L.ROW_OVERLAP)


@query(f"WITH RECURSIVE {ROWS_SQL} SELECT doc_id, page_no, line_no, grp AS row FROM placed_rows")
def layout_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.visual_rows(_celled(spark, sf_dir), PAGE).select(*PAGE, "line_no", "row")


@query(rf"""WITH RECURSIVE {ROWS_SQL}, rowed AS (SELECT c.*, r.grp AS row FROM celled c JOIN placed_rows r USING (doc_id, page_no, line_no)),
stepped AS (SELECT *, trim(lag(text) OVER o) AS before, x0 - lag(x1) OVER o AS gap, lag(size) OVER o AS before_size FROM rowed WINDOW o AS (PARTITION BY doc_id, page_no, row ORDER BY x0, line_no)),
split AS (SELECT *, CASE WHEN coalesce(gap < greatest(9.0, 1.1 * greatest(before_size, 1.0)) OR ((before IN ('•', '●', '○', '◦', '▪', '§', '·', '-', '—', '–') OR regexp_matches(before, '^\s*(?:[a-zA-Z]\)|\(?[ivxIVX]{{1,5}}\)|\d{{1,2}}[.)]|[•●○◦▪§·])\s*$')) AND gap < 60), false) THEN 0 ELSE 1 END AS fresh FROM stepped),
parts AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id, page_no, row ORDER BY x0, line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS part FROM split)
SELECT doc_id, page_no, row, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, max(size) AS size, CAST(min(line_no) AS INT) AS line_no, list(line_no ORDER BY line_no) AS line_nos, string_agg(text, ' ' ORDER BY x0, line_no) AS text,
  CASE WHEN count(*) > 1 AND (trim(first(text ORDER BY x0, line_no)) IN ('•', '●', '○', '◦', '▪', '§', '·', '-', '—', '–') OR regexp_matches(trim(first(text ORDER BY x0, line_no)), '^\s*(?:[a-zA-Z]\)|\(?[ivxIVX]{{1,5}}\)|\d{{1,2}}[.)]|[•●○◦▪§·])\s*$'))
    THEN list(x0 ORDER BY x0, line_no)[2] END AS hang_x0
FROM parts GROUP BY doc_id, page_no, row, part""".replace("\\\\", "\\"))
def layout_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.merge_fragments(L.visual_rows(_celled(spark, sf_dir), PAGE), PAGE)


@query(f"""WITH RECURSIVE {ROWS_SQL}, {_first_fit("placed_bands", "celled", "x0", "x0", "x1", L.BAND_OVERLAP)}, alone AS (SELECT doc_id, page_no, count(DISTINCT grp) = count(*) AS alone FROM placed_rows GROUP BY doc_id, page_no)
SELECT doc_id, page_no, line_no, CASE WHEN alone THEN 0 ELSE grp END AS band FROM placed_bands JOIN alone USING (doc_id, page_no)""")
def layout_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.column_bands(L.visual_rows(_celled(spark, sf_dir), PAGE), PAGE).select(*PAGE, "line_no", "band")


EVEN = GROUPED.replace(" + CASE WHEN line_no % 7 = 0 THEN 10 ELSE 0 END", "")


@query(rf"""WITH {EVEN}, paras AS (
  SELECT doc_id, page_no, para, string_agg(text, ' ' ORDER BY y0, x0, line_no) AS text, CAST(count(*) AS INT) AS lines, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1,
    first(x0 ORDER BY y0, x0, line_no) - min(x0) AS indent, first(size ORDER BY length(text) DESC, line_no) AS size FROM grouped GROUP BY doc_id, page_no, para)
SELECT * FROM paras WHERE NOT (lines = 1 AND size > 1.5 * (y1 - y0))""")
def layout_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole extraction, from spans to paragraphs; each line is one span."""
    even = lined(spark, sf_dir).withColumn("y0", 14.0 * (F.col("line_no") % 40)).withColumn("y1", F.col("y0") + 12)
    spans = even.withColumn("span_no", F.lit(0)).withColumn("font", F.lit("Helvetica")).withColumn("bold", F.lit(False)).withColumn("italic", F.lit(False)).withColumn("color", F.lit(0))
    return L.extract_paragraphs(spans, PAGE).select(*PAGE, "para", "text", "lines", "x0", "y0", "x1", "y1", "indent", "size")


@query(rf"""WITH RECURSIVE {GEOMETRY}, flowing AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY y0, x0, line_no) AS place, max(x1) OVER (PARTITION BY doc_id, page_no) AS edge, line_no % 13 = 0 AS item,
    regexp_matches(text, '^\s*(?:[a-zA-Z]\)|\(?[ivxIVX]{{1,4}}\)|\d{{1,2}}[.)]|[•●○◦▪§·]|[-–—]\s)\s*') AS marker, regexp_matches(text, '^[\p{{Ll}}\p{{Nd}}]') AS small FROM lined
), folded AS (
  SELECT doc_id, page_no, place, line_no AS para, text, x0, y0, x1, y1, size, CAST(NULL AS DOUBLE) AS lead_, 'left' AS align, 1 AS merged FROM flowing WHERE place = 1
  UNION ALL
  SELECT doc_id, page_no, place, CASE WHEN j THEN para ELSE line_no END, CASE WHEN j THEN f_text || ' ' || text ELSE text END, CASE WHEN j THEN least(f_x0, x0) ELSE x0 END, CASE WHEN j THEN least(f_y0, y0) ELSE y0 END,
    CASE WHEN j THEN greatest(f_x1, x1) ELSE x1 END, CASE WHEN j THEN greatest(f_y1, y1) ELSE y1 END, CASE WHEN j THEN f_size ELSE size END,
    CASE WHEN NOT j THEN NULL WHEN lead_ IS NULL OR merged = 1 THEN greatest(y0 - f_y1 + f_size, 1.15 * f_size) ELSE lead_ END, CASE WHEN j THEN 'justify' ELSE 'left' END, CASE WHEN j THEN merged + 1 ELSE 1 END
  FROM (SELECT p.*, f.para, f.text AS f_text, f.x0 AS f_x0, f.y0 AS f_y0, f.x1 AS f_x1, f.y1 AS f_y1, f.size AS f_size, f.lead_, f.merged,
      NOT p.marker AND NOT p.item AND abs(p.x0 - f.x0) < 12 AND abs(p.size - f.size) <= 0.6 AND p.y0 - f.y1 >= -1 AND p.y0 - f.y1 <= 0.85 * coalesce(f.lead_, f.size * 1.18)
        AND (f.x1 >= p.edge - greatest(14.0, 1.6 * f.size) OR (NOT regexp_matches(f.text, '[.:;!?"”]\s*$') AND p.small)) AS j
    FROM folded f JOIN flowing p ON p.doc_id = f.doc_id AND p.page_no = f.page_no AND p.place = f.place + 1)
)
SELECT doc_id, page_no, para, text, align, merged FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page_no, para ORDER BY place DESC) AS r FROM folded) WHERE r = 1""")
def layout_flow_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    paras = lined(spark, sf_dir).select(
        *PAGE, F.col("line_no").alias("para"), "text", "x0", "y0", "x1", "y1", "size", F.lit(None).cast("double").alias("leading"), F.lit("left").alias("align"),
        (F.col("line_no") % 13 == 0).alias("starts_item"), F.lit(False).alias("has_clip"), F.lit(None).cast("double").alias("hang_x0"),
    )
    return L.merge_flowing(paras, PAGE).select(*PAGE, "para", "text", "align", "merged")


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(F.split("text", " ")).alias("span_no", "text"))
    n = F.col("span_no")
    return words.select("conv_id", "turn", F.floor(n / 10).cast("int").alias("line_no"), "span_no", "text", F.lit("Helvetica").alias("font"), (n % 7 == 0).alias("bold"), F.lit(False).alias("italic"), F.lit(0).alias("color"), (11.0 + 0.3 * (n % 4)).alias("size"))


@query(r"""WITH RECURSIVE words AS (SELECT conv_id, turn, string_split(text, ' ') AS w FROM conversations), spans AS (
  SELECT conv_id, turn, CAST(i AS INT) AS span_no, CAST(i // 10 AS INT) AS line, w[i + 1] AS text, i % 7 = 0 AS bold, 11.0::DOUBLE + 0.3::DOUBLE * (i % 4) AS size FROM words t, unnest(range(len(t.w))) AS u(i) WHERE w[i + 1] <> ''
), placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY span_no) AS place FROM spans), folded AS (
  SELECT conv_id, turn, place, 0 AS run, bold, size AS opened, text, line, line AS last_line, '' AS tail FROM placed WHERE place = 1
  UNION ALL
  SELECT p.conv_id, p.turn, p.place, CASE WHEN p.bold = f.bold AND abs(f.opened - p.size) <= 0.75 THEN f.run ELSE f.run + 1 END, p.bold, CASE WHEN p.bold = f.bold AND abs(f.opened - p.size) <= 0.75 THEN f.opened ELSE p.size END, p.text, p.line, f.line, ''
  FROM folded f JOIN placed p ON p.conv_id = f.conv_id AND p.turn = f.turn AND p.place = f.place + 1
), turned AS (SELECT *, lead(line) OVER (PARTITION BY conv_id, turn ORDER BY place) AS next_line FROM folded),
joined AS (SELECT conv_id, turn, run, any_value(bold) AS bold, any_value(opened) AS size, string_agg(text || CASE WHEN next_line > line THEN ' ' ELSE '' END, '' ORDER BY place) AS text FROM turned GROUP BY conv_id, turn, run)
SELECT conv_id, turn, run, regexp_replace(text, '\s+', ' ', 'g') AS text, 'Helvetica' AS font, bold, false AS italic, 0 AS color, round_even(size, 1) AS size FROM joined""")
def layout_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.build_runs(_spans(spark, sf_dir), ["conv_id", "turn"])


@query(f"""WITH {GEOMETRY}, p AS (SELECT *, CASE WHEN line_no % 3 = 0 THEN 52.0 END AS c0, CASE WHEN line_no % 3 = 0 THEN 300.0 END AS c1, CASE WHEN line_no % 3 = 0 THEN y1 + 40 END AS cy FROM lined),
s AS (SELECT *, CASE WHEN c0 IS NOT NULL THEN greatest(x0, c0) ELSE x0 END AS r0, CASE WHEN c0 IS NOT NULL THEN least(greatest(x1, greatest(x0, c0) + 10.0), c1 + 2.5) ELSE x1 END AS r1 FROM p),
n AS (SELECT s.doc_id, s.page_no, s.line_no, min(o.y0) - 1.0 AS nearest FROM s JOIN p o ON o.doc_id = s.doc_id AND o.page_no = s.page_no AND o.line_no <> s.line_no AND o.y0 >= s.y1 - 0.5 AND o.x1 > s.r0 + 1 AND o.x0 < s.r1 - 1 GROUP BY ALL)
SELECT s.doc_id, s.page_no, s.line_no AS para, r0 AS room_x0, r1 AS room_x1, greatest(y1, least(coalesce(nearest, 1e30), coalesce(cy - 1.0, 1e30), 700.0 - 18.0)) AS room_y1
FROM s LEFT JOIN n ON n.doc_id = s.doc_id AND n.page_no = s.page_no AND n.line_no = s.line_no""")
def available_rect(spark: SparkSession, sf_dir: str) -> DataFrame:
    column = F.col("line_no") % 3 == 0
    paras = lined(spark, sf_dir).withColumnRenamed("line_no", "para")
    column = F.col("para") % 3 == 0
    clipped = paras.withColumn("clip_x0", F.when(column, 52.0)).withColumn("clip_x1", F.when(column, 300.0)).withColumn("clip_y1", F.when(column, F.col("y1") + 40)).withColumn("page_height", F.lit(700.0))
    return L.available_rect(clipped, PAGE).select(*PAGE, "para", "room_x0", "room_x1", "room_y1")


SEGMENTS = """turns AS (SELECT conv_id, turn, CASE WHEN turn % 4 = 1 THEN 'Asunto:' WHEN turn % 6 = 2 THEN ' ' ELSE text END AS text, CASE WHEN turn % 4 = 1 THEN 'bold' ELSE role END AS style FROM conversations),
started AS (SELECT *, CASE WHEN row_number() OVER o = 1 OR style IS DISTINCT FROM lag(style) OVER o THEN 1 ELSE 0 END AS s FROM turns WINDOW o AS (PARTITION BY conv_id ORDER BY turn)),
numbered AS (SELECT *, CAST(sum(s) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS segment FROM started),
segments AS (SELECT conv_id, segment, any_value(style) AS style, string_agg(text, '' ORDER BY turn) AS text FROM numbered GROUP BY conv_id, segment HAVING trim(regexp_replace(string_agg(text, '' ORDER BY turn), '\\s+', '', 'g')) <> '')"""


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    label, blank = F.col("turn") % 4 == 1, F.col("turn") % 6 == 2
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(label, "Asunto:").when(blank, " ").otherwise(F.col("text")).alias("text"), F.when(label, "bold").otherwise(F.col("role")).alias("style"))
    return R.style_segments(turns, ["conv_id"], "turn")


@query(f"WITH {SEGMENTS} SELECT conv_id, segment, style, text FROM segments")
def style_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _segments(spark, sf_dir)


@query(f"WITH {SEGMENTS} SELECT conv_id, first(style ORDER BY length(text) DESC, segment) AS dominant FROM segments GROUP BY conv_id")
def dominant_style(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.dominant_style(_segments(spark, sf_dir), ["conv_id"])


SPLITS = SEGMENTS + r""", s AS (SELECT conv_id, list(struct_pack(segment := segment, style := style, text := text) ORDER BY segment) AS a, first(style ORDER BY length(text) DESC, segment) AS dominant FROM segments GROUP BY conv_id),
h AS (SELECT conv_id, a, dominant, regexp_replace(a[1].text, '^\s+|\s+$', '', 'g') AS head, regexp_replace(array_to_string(list_transform(a[2:], lambda x: x.text), ''), '^\s+|\s+$', '', 'g') AS rest,
  regexp_replace(array_to_string(list_transform(a, lambda x: x.text), ''), '^\s+|\s+$', '', 'g') AS whole FROM s),
splits AS (SELECT conv_id, head, rest, whole, len(a) >= 2 AND length(head) <= 90 AND rest <> '' AND a[1].style <> dominant AND regexp_matches(head, '[:.]$') AS is_label FROM h)"""


@query(f"WITH {SPLITS} SELECT conv_id, head, rest, is_label FROM splits")
def label_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.label_splits(_segments(spark, sf_dir), ["conv_id"]).select("conv_id", "head", "rest", "is_label")


_FAILS = "CAST('0x' || substr(md5({0}), 1, 7) AS BIGINT) % 3 = 0"


@query(f"""WITH {SPLITS}, tried AS (SELECT *, is_label AND NOT ({_FAILS.format('head')}) AND NOT ({_FAILS.format('rest')}) AS good FROM splits)
SELECT conv_id, CASE WHEN good THEN 'label' ELSE 'whole' END AS how, CASE WHEN good THEN lower(head) END AS en_head,
  CASE WHEN good THEN lower(rest) WHEN whole = '' OR {_FAILS.format('whole')} THEN NULL ELSE lower(whole) END AS en_body, CASE WHEN NOT good AND whole <> '' AND {_FAILS.format('whole')} THEN 'failed' ELSE 'ok' END AS status FROM tried""")
def paragraph_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels and bodies by a stand-in that fails a third of all texts."""
    fails = text_hash(F.col("unit")) % 3 == 0
    answer = lambda units: units.select("unit", F.when(~fails, F.lower("unit")).alias("en"), F.when(fails, "failed").otherwise("ok").alias("status"))
    return R.translate_paragraphs(R.label_splits(_segments(spark, sf_dir), ["conv_id"]), ["conv_id"], answer)


@query(f"""WITH RECURSIVE {CASED}, t AS (SELECT doc_id, line_no, 14.0::DOUBLE * (1 + length(unit) / 60) AS height, list_filter(string_split(unit, ' '), lambda w: w <> '') AS w FROM cased),
e AS (SELECT doc_id, line_no, height, list_transform(range(1, len(w) + 1), lambda i: len(array_to_string(w[1:i], ' ')) + 1) AS ends FROM t),
rungs AS (SELECT doc_id, line_no, height, ends, rung, greatest(11.0::DOUBLE * 0.72, 11.0::DOUBLE - 0.25 * rung) AS size FROM e, (SELECT unnest(range(0, 14)) AS rung)),
roomy AS (SELECT *, 220.0::DOUBLE / (size * 0.55::DOUBLE) + 1 + 1e-9 AS room FROM rungs),
wrapped AS (
  SELECT doc_id, line_no, height, ends, rung, size, room, 0::BIGINT AS spot, 0 AS lines FROM roomy
  UNION ALL
  SELECT doc_id, line_no, height, ends, rung, size, room, greatest(spot + 1, spot + len(list_filter(ends[spot + 1 : spot + 60], lambda x: x <= coalesce(ends[spot], 0) + room))), lines + 1 FROM wrapped WHERE spot < len(ends)
), counted AS (SELECT doc_id, line_no, height, rung, size, CAST(max(lines) AS INT) AS lines FROM wrapped GROUP BY ALL),
fitted AS (SELECT *, 13.0::DOUBLE * size / 11 AS ld, (lines - 1) * (13.0::DOUBLE * size / 11) + size AS bottom FROM counted),
best AS (SELECT doc_id, line_no, min(CASE WHEN bottom <= height OR rung = 13 THEN rung END) AS rung FROM fitted GROUP BY doc_id, line_no)
SELECT doc_id, line_no, size AS fit_size, ld AS fit_leading, lines AS fit_lines, size < 11 AS scaled, bottom > height AS overflow FROM fitted JOIN best USING (doc_id, line_no, rung)""")
def fit_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = cased(spark, sf_dir).select(
        "doc_id", "line_no", F.col("unit").alias("text"), F.lit(11.0).alias("size"), F.lit(220.0).alias("room"), (14.0 * (1 + F.length("unit") / 60)).alias("height"), F.lit(13.0).alias("leading"), F.lit(0.0).alias("first_indent")
    )
    return D.fit_paragraphs(lines).select("doc_id", "line_no", "fit_size", "fit_leading", "fit_lines", "scaled", "overflow")


@query(f"""WITH {CASED}, words AS (SELECT doc_id, line_no, replace(unit, ' ', '') AS w FROM cased)
SELECT doc_id, line_no, greatest(11.0 * 0.72, 11.0 - 0.25 * ceil(greatest(0, 11.0 - h) / 0.25)) AS fit_size FROM (SELECT *, 8.0 + length(w) % 4 AS h FROM words) WHERE w <> ''""")
def fit_one_word(spark: SparkSession, sf_dir: str) -> DataFrame:
    word = F.replace("unit", F.lit(" "), F.lit(""))
    lines = cased(spark, sf_dir).select("doc_id", "line_no", word.alias("text"), F.lit(11.0).alias("size"), F.lit(220.0).alias("room"), (8.0 + F.length(word) % 4).alias("height"), F.lit(13.0).alias("leading"), F.lit(0.0).alias("first_indent"))
    return D.fit_paragraphs(lines).select("doc_id", "line_no", "fit_size")


def _pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as rows of eight pixels: positive values are ink."""
    cells = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "e"))
    return cells.select("vec_id", F.expr("i DIV 8").cast("int").alias("row"), (F.col("i") % 8).alias("col"), F.when(F.col("e") > 0, 100.0 + F.col("i") % 50).otherwise(255.0 - F.col("i") % 50).alias("value"))


PIXELS = """pixels AS (SELECT vec_id, CAST(i // 8 AS INT) AS r, CAST(i % 8 AS INT) AS c, CASE WHEN embedding[i + 1] > 0 THEN 100.0::DOUBLE + i % 50 ELSE 255.0::DOUBLE - i % 50 END AS v
  FROM embeddings e, unnest(range(len(e.embedding))) AS u(i))"""


@query(f"""WITH {PIXELS}, inked AS (SELECT vec_id, r, c - row_number() OVER (PARTITION BY vec_id, r ORDER BY c) AS island FROM pixels WHERE v < 165), runs AS (SELECT vec_id, r, island, count(*) AS run FROM inked GROUP BY ALL),
found AS (SELECT vec_id, CAST(sum(run) AS BIGINT) AS ink, count(*) AS runs, median(run) AS middle FROM runs GROUP BY vec_id)
SELECT vec_id, ink, runs, CASE WHEN ink >= 60 AND runs >= 20 THEN middle / (11.0::DOUBLE * 2) END AS stem_ratio, coalesce(CASE WHEN ink >= 60 AND runs >= 20 THEN middle / (11.0::DOUBLE * 2) END >= 0.155, false) AS is_bold FROM found""")
def stem_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.stem_ratios(_pixels(spark, sf_dir), ["vec_id"], F.lit(11.0), 2.0)


@query(f"WITH {PIXELS} SELECT vec_id, quantile_cont(v, 0.82) AS fill, least(stddev_pop(v), 6.0) AS noise FROM pixels GROUP BY vec_id")
def fill_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.fill_values(_pixels(spark, sf_dir), ["vec_id"])


@query(f"WITH {PIXELS} SELECT vec_id, count(*) FILTER (v < 165) AS ink, count(DISTINCT CASE WHEN v < 165 THEN r END) AS inked_rows, count(*) FILTER (v < 165) >= 12 AND count(DISTINCT CASE WHEN v < 165 THEN r END) < 0.9 * 8 AS starts_item FROM pixels GROUP BY vec_id")
def bullet_ink(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.bullet_ink(_pixels(spark, sf_dir), ["vec_id"], 8)


FONTS = ["ABCDEF+Book Antiqua", "Arial,Bold", "ABCDEF+Britannic Bold", "TimesNewRomanPS-BoldMT", "Calibri-BoldItalic", "GlyphLessFont", "Courier-Oblique", "", "NotoSans-Regular"]
INDEX = [("arial", False, False, "a.ttf"), ("arial", True, False, "ab.ttf"), ("britannic bold", False, False, "bb.ttf"), ("calibri", False, True, "ci.ttf"), ("georgia", False, False, "g.ttf"), ("georgia", True, True, "gbi.ttf")]
BUNDLED = [("monospace fallback", False, False, "m.ttf")]
RESOLVED_FONTS = [
    ("ABCDEF+Book Antiqua", "georgia", "g.ttf", False, False, True), ("Arial,Bold", "arial", "ab.ttf", True, False, False), ("ABCDEF+Britannic Bold", "britannic bold", "bb.ttf", True, False, False),
    ("TimesNewRomanPS-BoldMT", "georgia", "g.ttf", True, False, True), ("Calibri-BoldItalic", "calibri", "ci.ttf", True, True, False), ("GlyphLessFont", "arial", "a.ttf", False, False, False),
    ("Courier-Oblique", "monospace fallback", "m.ttf", False, True, True), ("", "arial", "a.ttf", False, False, False), ("NotoSans-Regular", "arial", "a.ttf", False, False, True),
]


@query("SELECT * FROM (VALUES " + ", ".join(str(r) for r in RESOLVED_FONTS) + ") AS t(font, resolved, path, bold, italic, substituted)")
def font_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = "family string, bold boolean, italic boolean, path string"
    return D.resolve_fonts(spark.createDataFrame([(f,) for f in FONTS], "font string"), spark.createDataFrame(INDEX, schema), spark.createDataFrame(BUNDLED, schema), "Arial")


@query(f"""WITH {LINES} SELECT doc_id, page_no, line_no AS para, CASE WHEN line_no % 5 = 0 THEN 'deleted' WHEN line_no % 5 = 1 AND upper(replace(line, 'ß', 'ss')) <> line THEN 'modified' ELSE 'kept' END AS action,
  CASE WHEN line_no % 5 = 0 THEN NULL WHEN line_no % 5 = 1 THEN upper(replace(line, 'ß', 'ss')) ELSE line END AS final_text FROM lines""")
def reflow_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.plans.translate import lines_of

    paras = lines_of(table(spark, sf_dir, "documents")).select(*PAGE, F.col("line_no").alias("para"), F.col("line").alias("text"))
    edits = paras.where("para % 5 < 2").select(*PAGE, "para", F.upper("text").alias("text"), (F.col("para") % 5 == 0).alias("deleted"))
    return D.apply_edits(paras, edits, PAGE).select(*PAGE, "para", "action", "final_text")


@query(f"""WITH {LINES}, p AS (SELECT DISTINCT doc_id, page_no FROM lines) SELECT doc_id, CAST(2 * page_no + n AS INT) AS position, side, page_no FROM p, (VALUES (0, 'source'), (1, 'translated')) AS s(n, side) WHERE page_no % 3 < 2""")
def dual_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.plans.translate import lines_of

    pages = lines_of(table(spark, sf_dir, "documents")).select(*PAGE).distinct()
    return D.dual_manifest(pages, pages.where("page_no % 3 < 2"))


@query("SELECT max(w) AS sheet_width, CAST(sum(h) + 10 * (count(*) - 1) AS BIGINT) AS sheet_height FROM (SELECT 500 + page_id % 90 + 510 + 18 AS w, greatest(700 + page_id % 30, 710) + 26 AS h FROM pages)")
def comparison_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = F.col("page_id")
    tiles = table(spark, sf_dir, "pages").select((500 + page % 90).alias("width_a"), (700 + page % 30).alias("height_a"), F.lit(510).alias("width_b"), F.lit(710).cast("long").alias("height_b"))
    return D.comparison_sheet(tiles)
