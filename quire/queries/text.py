"""Queries over text expressions and entities."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import ordinals, rules
from quire.functions import text as X
from quire.operators import entities as E
from quire.operators import glossary as G
from quire.plans.translate import lines_of
from quire.queries import query, table
from quire.queries.common import CASED, LETTERS, LINES, ROSTER, TERMS_SQL, UNITS, cased, glossary, units

ORDINAL_SQL = ordinals.ALTERNATIVES
ORDINAL_CASE = "CASE spanish " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in ordinals.ORDINALS.items()) + " ELSE '' END"
MARKER_SQL = r"^\s*((?:[a-zA-Z]\)|\(?[ivxIVX]{1,5}\)|\d{1,2}[.)]|[•●○◦▪§·]))\s+"


@query(f"WITH {UNITS} SELECT doc_id, line_no, page_no, unit FROM units")
def text_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return units(spark, sf_dir)


@query(f"WITH {LINES} SELECT doc_id, line_no, strip_accents(line) AS plain, replace(lower(strip_accents(line)), 'ß', 'ss') AS folded FROM lines")
def strip_accents_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines_of(table(spark, sf_dir, "documents")).select("doc_id", "line_no", X.strip_accents(F.col("line")).alias("plain"), X.fold(F.col("line")).alias("folded"))


@query(r"SELECT page_id, trim(replace(regexp_replace(url, '^https?:', ''), '\', '/'), '/') AS rel, 'out/' || trim(replace(regexp_replace(url, '^https?:', ''), '\', '/'), '/') AS target FROM pages")
def canonical_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.regexp_replace("url", "^https?:", "")
    return table(spark, sf_dir, "pages").select("page_id", X.norm_path(path).alias("rel"), X.join_path(F.lit("out/"), path).alias("target"))


@query(r"SELECT page_id, right(regexp_replace(url, '[^\p{L}\p{N}]', '_', 'g'), 90) AS key FROM pages")
def cache_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", X.cache_key(F.col("url")).alias("key"))


TRANSLATABLE_SQL = rf"""trim(s) <> '' AND NOT regexp_matches(trim(s), '^[\s\d.,:;%$/()\-+*=<>#&@''"\[\]{{}}|\\^~`!?]*$')
  AND NOT regexp_matches(trim(s), '^[=+\-@]') AND regexp_matches(trim(s), '[{LETTERS}]{{2,}}')"""


@query(
    f"WITH {LINES}, cells AS (SELECT doc_id, line_no, CASE line_no % 11 WHEN 0 THEN '=A1+B' || doc_id WHEN 1 THEN '12,5 %' WHEN 2 THEN '' ELSE line END AS s FROM lines) "
    f"SELECT doc_id, s AS text, CAST(min(line_no) AS INT) AS first_line FROM cells WHERE {TRANSLATABLE_SQL} GROUP BY doc_id, s"
)
def translatable_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.operators.office import first_seen

    place = F.col("line_no") % 11
    cell = F.when(place == 0, F.concat(F.lit("=A1+B"), F.col("doc_id").cast("string"))).when(place == 1, "12,5 %").when(place == 2, "").otherwise(F.col("line"))
    cells = lines_of(table(spark, sf_dir, "documents")).select("doc_id", "line_no", cell.alias("text"))
    return first_seen(cells, ["doc_id"], ["line_no"]).select("doc_id", "text", F.col("first_at.line_no").alias("first_line"))


def _doubled(text: str) -> str:
    return "".join(c if re.match(f"[{LETTERS}0-9]", c) else c * 2 for c in text)


_NAMES_SQL = "|".join(re.sub(r"([.$(),|*+?^])", r"\\\1", _doubled(s)) for s in E.spellings(ROSTER))
TOKENS_SQL = rf"(?i)(?:^|[^{LETTERS}0-9])({_NAMES_SQL})(?:[^{LETTERS}0-9]|$)|(RD\$\$(?:\d|\.\.|,,)+|US\$\$(?:\d|\.\.|,,)+|\$\$(?:\d|\.\.|,,)+|\b\d(?:\d|\.\.|,,)*\b)"


@query(rf"""WITH {CASED}, twice AS (SELECT doc_id, line_no, regexp_replace(unit, '([^{LETTERS}0-9])', '\1\1', 'g') AS t FROM cased),
found AS (SELECT doc_id, line_no, regexp_extract_all(t, '{TOKENS_SQL}', 1) AS a, regexp_extract_all(t, '{TOKENS_SQL}', 2) AS b FROM twice)
SELECT doc_id, line_no, array_to_string(list_transform(range(len(a)), lambda i: regexp_replace(coalesce(a[i + 1], '') || coalesce(b[i + 1], ''), '([^{LETTERS}0-9])[^{LETTERS}0-9]', '\1', 'g')), '|') AS tokens, CAST(len(a) AS INT) AS n
FROM found""")
def protect_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, tokens = E.protect(F.col("unit"), E.protect_pattern(ROSTER))
    return cased(spark, sf_dir).select("doc_id", "line_no", F.array_join(tokens, "|").alias("tokens"), F.size(tokens).alias("n"))


@query(f"WITH {CASED} SELECT doc_id, line_no, unit AS restored, true AS complete FROM cased")
def protect_restore_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked, tokens = E.protect(F.col("unit"), E.protect_pattern(ROSTER))
    loose = F.replace(F.replace(marked, F.lit("[["), F.lit("[[ ")), F.lit("]]"), F.lit(" ]]"))
    back = E.restore(loose, tokens)
    return cased(spark, sf_dir).select("doc_id", "line_no", back.alias("restored"), E.all_restored(back).alias("complete"))


_ROSTER_SQL = "roster(entity) AS (VALUES " + ", ".join(f"('{e}')" for e in ROSTER) + ")"
_FRAGMENTS_SQL = _ROSTER_SQL + """, fragments AS (
  SELECT DISTINCT trim(upper(strip_accents(w)), '.,;:()"') AS fragment FROM (
    SELECT unnest(string_split(entity, ' ')) AS w FROM (SELECT c_name AS entity FROM customer UNION ALL SELECT p_name FROM part UNION ALL SELECT entity FROM roster) WHERE contains(entity, ' '))
  WHERE length(trim(upper(strip_accents(w)), '.,;:()"')) >= 3)"""


@query(f"WITH {_FRAGMENTS_SQL} SELECT fragment FROM fragments")
def entity_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    roster = spark.createDataFrame([(e,) for e in ROSTER], "entity string")
    names = table(spark, sf_dir, "customer").select(F.col("c_name").alias("entity")).union(table(spark, sf_dir, "part").select("p_name")).union(roster)
    return E.name_fragments(names)


_WORDS_SQL = ", ".join(f"'{w}'" for w in E.fragment_words(ROSTER))


@query(f"""WITH {CASED} SELECT doc_id, line_no, unit FROM cased WHERE upper(strip_accents(trim(trim(unit), '.,;:()"'))) IN ({_WORDS_SQL})""")
def name_fragment_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cased(spark, sf_dir).where(E.is_name_fragment(F.col("unit"), ROSTER)).select("doc_id", "line_no", "unit")


_FOLDED = sorted({E.without_accents(e).casefold() for e in ROSTER}, key=lambda s: (-len(s), s))
WHOLE_SQL = "replace(lower(strip_accents(trim(unit))), 'ß', 'ss')"
_REST_SQL = WHOLE_SQL
for _name in _FOLDED:
    _REST_SQL = f"replace({_REST_SQL}, '{_name}', ' ')"
WHOLLY_SQL = "(" + " OR ".join(f"contains({WHOLE_SQL}, '{n}')" for n in _FOLDED) + f") AND NOT regexp_matches({_REST_SQL}, '[{LETTERS}]{{3,}}')"
GUARDED_SQL = f"""(upper(strip_accents(trim(trim(unit), '.,;:()"'))) IN ({_WORDS_SQL}) OR {WHOLLY_SQL})"""


@query(f"WITH {CASED} SELECT doc_id, line_no, unit FROM cased WHERE {WHOLLY_SQL}")
def wholly_protected_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cased(spark, sf_dir).where(E.is_wholly_protected(F.col("unit"), ROSTER)).select("doc_id", "line_no", "unit")


@query(rf"""WITH {CASED}, {TERMS_SQL}
SELECT doc_id, line_no, unit, coalesce(a.translation, regexp_extract(unit, '^(\d{{1,2}}(?:\.\d{{1,2}})?\.?)\s+(.*)$', 1) || ' ' || b.translation) AS hit
FROM cased LEFT JOIN terms a ON a.term = unit
LEFT JOIN terms b ON regexp_matches(unit, '^(\d{{1,2}}(?:\.\d{{1,2}})?\.?)\s+(.*)$') AND b.term = trim(regexp_extract(unit, '^(\d{{1,2}}(?:\.\d{{1,2}})?\.?)\s+(.*)$', 2))""")
def glossary_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.lookup(cased(spark, sf_dir), glossary(spark), into="hit").select("doc_id", "line_no", "unit", "hit")


@query(f"WITH {TERMS_SQL} SELECT * FROM terms")
def glossary_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.merge_glossary(glossary(spark))


@query(f"""WITH {CASED}, o AS (SELECT doc_id, line_no, unit, regexp_extract(upper(strip_accents(unit)), '^({ORDINAL_SQL})(?:[.,: )]|$)', 1) AS spanish FROM cased)
SELECT doc_id, line_no, {ORDINAL_CASE} AS english, substr(unit, length(spanish) + 1) AS tail FROM o WHERE spanish <> ''""")
def ordinal_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    spanish = ordinals.ordinal(F.col("unit"))
    found = cased(spark, sf_dir).withColumn("spanish", spanish).where("spanish <> ''")
    tail = F.substring("unit", F.length("spanish") + 1, F.length("unit"))
    return found.select("doc_id", "line_no", ordinals.english_ordinal(F.col("spanish")).alias("english"), tail.alias("tail"))


@query(rf"""WITH {CASED}, m AS (SELECT doc_id, line_no, regexp_extract(unit, '{MARKER_SQL}', 1) AS marker, regexp_replace(unit, '{MARKER_SQL}', '') AS rest FROM cased),
o AS (SELECT *, regexp_extract(upper(strip_accents(rest)), '^({ORDINAL_SQL})(?:[.,: )]|$)', 1) AS spanish FROM m),
t AS (SELECT *, regexp_extract(substr(rest, length(spanish) + 1), '^([.,:]*)', 1) AS signs FROM o)
SELECT doc_id, line_no, CASE WHEN marker <> '' THEN marker || ' ' ELSE '' END || CASE WHEN spanish <> '' THEN {ORDINAL_CASE} || signs || ' ' ELSE '' END AS prefix,
  CASE WHEN spanish <> '' THEN ltrim(substr(rest, length(spanish) + length(signs) + 1)) ELSE rest END AS rest FROM t""")
def list_prefix_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    prefix, rest = ordinals.split_prefix(F.col("unit"))
    return cased(spark, sf_dir).select("doc_id", "line_no", prefix.alias("prefix"), rest.alias("rest"))


def _date_text(kind, d, m, y):
    one = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    return (
        F.when(kind == 0, one("paid ", d, " of ", m, " of ", y)).when(kind == 1, one("on ", d, " of ", m, ", ", y)).when(kind == 2, one(m, " ", d, " of ", y, "."))
        .when(kind == 3, one("due ", d, " ", m, " ", y)).when(kind == 4, one(m, " ", d, " ", y)).when(kind == 5, one("the ", m, " ", d, ",, paid")).otherwise(one("Sunday  Domingo, ", d))
    )


_DATE_SQL = """CASE o_orderkey % 7 WHEN 0 THEN 'paid ' || d || ' of ' || m || ' of ' || y WHEN 1 THEN 'on ' || d || ' of ' || m || ', ' || y WHEN 2 THEN m || ' ' || d || ' of ' || y || '.'
  WHEN 3 THEN 'due ' || d || ' ' || m || ' ' || y WHEN 4 THEN m || ' ' || d || ' ' || y WHEN 5 THEN 'the ' || m || ' ' || d || ',, paid' ELSE 'Sunday  Domingo, ' || d END"""
_RULED_SQL = "note"
for _pattern, _replacement in [r for i, r in enumerate(rules.DATE_RULES) if i != 5]:
    _RULED_SQL = f"regexp_replace({_RULED_SQL}, '{_pattern}', '{_replacement}', 'g')"


def _dated(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    day, year = F.dayofmonth("o_orderdate").cast("string"), F.year("o_orderdate").cast("string")
    return orders.select("o_orderkey", _date_text(F.col("o_orderkey") % 7, day, F.date_format("o_orderdate", "MMMM"), year).alias("note"))


@query(f"""WITH parts AS (SELECT o_orderkey, CAST(day(o_orderdate) AS VARCHAR) AS d, monthname(o_orderdate) AS m, CAST(year(o_orderdate) AS VARCHAR) AS y FROM orders),
notes AS (SELECT o_orderkey, {_DATE_SQL} AS note FROM parts) SELECT o_orderkey, {_RULED_SQL} AS note FROM notes""")
def post_rules_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    without_lookahead = [r for i, r in enumerate(rules.DATE_RULES) if i != 5]
    return _dated(spark, sf_dir).select("o_orderkey", rules.apply_rules(F.col("note"), without_lookahead).alias("note"))


@query("SELECT o_orderkey, 'since ' || monthname(o_orderdate) || ' ' || day(o_orderdate) || ' it is due' AS note FROM orders")
def post_rules_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.dayofmonth("o_orderdate").cast("string")
    notes = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("since "), day, F.lit(" of "), F.date_format("o_orderdate", "MMMM"), F.lit(" it is due")).alias("note"))
    return notes.select("o_orderkey", rules.apply_rules(F.col("note"), rules.DATE_RULES).alias("note"))


_MARKED = "|".join(X.SOURCE_LANGUAGE_WORDS)
CLASSIFY_SQL = f"CASE WHEN en IS NULL OR trim(en) = '' THEN 'failed' WHEN trim(unit) = trim(en) AND regexp_matches(trim(unit), '(?i)(?:^|[^{LETTERS}0-9_])(?:{_MARKED})(?:[^{LETTERS}0-9_]|$)') THEN 'identical' ELSE 'ok' END"


@query(f"WITH {UNITS}, t AS (SELECT doc_id, line_no, unit, CASE line_no % 4 WHEN 0 THEN upper(unit) WHEN 1 THEN ' ' WHEN 2 THEN NULL ELSE unit END AS en FROM units) SELECT doc_id, line_no, {CLASSIFY_SQL} AS status FROM t")
def classify_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    place, unit = F.col("line_no") % 4, F.col("unit")
    en = F.when(place == 0, F.upper(unit)).when(place == 1, " ").when(place == 3, unit)
    return units(spark, sf_dir).select("doc_id", "line_no", X.classify_translation(unit, en).alias("status"))


_NUMBERS = r"\b\d[\d.,]*\b"


@query(rf"""WITH {CASED}, t AS (SELECT doc_id, line_no, unit, CASE WHEN line_no % 3 = 0 THEN replace(unit, '37', '73') ELSE upper(unit) || ' 5' END AS en FROM cased)
SELECT doc_id, line_no, list_sort(regexp_extract_all(unit, '{_NUMBERS}')) = list_sort(regexp_extract_all(en, '{_NUMBERS}')) AS same FROM t""")
def verify_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    en = F.when(F.col("line_no") % 3 == 0, F.replace("unit", F.lit("37"), F.lit("73"))).otherwise(F.concat(F.upper("unit"), F.lit(" 5")))
    return cased(spark, sf_dir).select("doc_id", "line_no", E.verified(F.col("unit"), en, []).alias("same"))


_ANY_NAME = "|".join(re.sub(r"([.$(),|*+?^])", r"\\\1", s) for s in E.spellings(ROSTER))


VERIFIED_SQL = rf"""len(list_filter(regexp_extract_all(unit, '(?i)({_ANY_NAME})'), lambda e: NOT contains(replace(lower(strip_accents({{en}})), 'ß', 'ss'), replace(lower(strip_accents(e)), 'ß', 'ss')))) = 0
  AND list_sort(regexp_extract_all(unit, '{_NUMBERS}')) = list_sort(regexp_extract_all({{en}}, '{_NUMBERS}'))"""


@query(rf"""WITH {CASED}, t AS (SELECT doc_id, line_no, unit, CASE WHEN line_no % 2 = 0 THEN lower(unit) ELSE replace(unit, 'Grupo', 'Group') END AS en FROM cased)
SELECT doc_id, line_no, len(list_filter(regexp_extract_all(unit, '(?i)({_ANY_NAME})'), lambda e: NOT contains(replace(lower(strip_accents(en)), 'ß', 'ss'), replace(lower(strip_accents(e)), 'ß', 'ss')))) = 0
  AND list_sort(regexp_extract_all(unit, '{_NUMBERS}')) = list_sort(regexp_extract_all(en, '{_NUMBERS}')) AS verified FROM t""")
def verify_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    en = F.when(F.col("line_no") % 2 == 0, F.lower("unit")).otherwise(F.replace("unit", F.lit("Grupo"), F.lit("Group")))
    return cased(spark, sf_dir).select("doc_id", "line_no", E.verified(F.col("unit"), en, ROSTER).alias("verified"))


@query(f"WITH {UNITS} SELECT doc_id, line_no, CASE WHEN contains(replace(lower(strip_accents(unit)), 'ß', 'ss'), 'stupid') THEN 'stupid' ELSE 'worthless' END AS term FROM units WHERE contains(replace(lower(strip_accents(unit)), 'ß', 'ss'), 'stupid') OR contains(replace(lower(strip_accents(unit)), 'ß', 'ss'), 'worthless')")
def deny_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.denied(units(spark, sf_dir), ["Stupid", "worthless"], "unit").select("doc_id", "line_no", F.col("terms")[0].alias("term"))


@query(r"""WITH {0} SELECT doc_id, line_no, regexp_replace(replace(replace(f, '''Hoja 1''!', '''Sheet One''!'), '''Hoja1''!', '''Sheet 2''!'), '(^|[^A-Za-z0-9_''!])Hoja1!', '\1Sheet 2!', 'g') AS formula,
  left(trim(regexp_replace('Tab [' || doc_id || '] ' || unit, '[:\\/?*\[\]]', ' ', 'g')), 31) AS title
FROM (SELECT doc_id, line_no, unit, 'SUM(''Hoja 1''!A' || line_no || ',Hoja1!B' || doc_id || ',MiHoja1!C1)' AS f FROM units)""".replace("{0}", UNITS))
def sheet_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    formula = F.concat(F.lit("SUM('Hoja 1'!A"), F.col("line_no").cast("string"), F.lit(",Hoja1!B"), F.col("doc_id").cast("string"), F.lit(",MiHoja1!C1)"))
    title = F.concat(F.lit("Tab ["), F.col("doc_id").cast("string"), F.lit("] "), F.col("unit"))
    renames = [("Hoja 1", "Sheet One"), ("Hoja1", "Sheet 2")]
    return units(spark, sf_dir).select("doc_id", "line_no", X.retarget_references(formula, renames).alias("formula"), X.sheet_title(title).alias("title"))
