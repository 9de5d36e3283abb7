"""Text expressions: cleaning, folding, paths, keys and predicates."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters of names, characters that carry no text, and bullets.
LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
PRIVATE_USE = "\\uE000-\\uF8FF"
ZERO_WIDTH = "\\u200B-\\u200D\\uFEFF"
BULLETS = ["•", "●", "○", "◦", "▪", "§", "·", "-", "—", "–"]
NUMBERS_ONLY = "^[\\d.,()%\\-\\s–—°ºª/:$]*$"
SYMBOLS_ONLY = "^[\\s\\d.,:;%$/()\\-+*=<>#&@'\"\\[\\]{}|\\\\^~`!?]*$"
FORMULA = "^[=+\\-@]"
LIST_MARKER = "^\\s*(?:[a-zA-Z]\\)|\\(?[ivxIVX]{1,4}\\)|\\d{1,2}[.)]|[•●○◦▪§·]|[-–—]\\s)\\s*"
STANDALONE_MARKER = "^\\s*(?:[a-zA-Z]\\)|\\(?[ivxIVX]{1,5}\\)|\\d{1,2}[.)]|[•●○◦▪§·])\\s*$"
LEADING_MARKER = "^\\s*([•●○◦▪§·]|[a-zA-Z]\\)|\\d{1,2}[.)])\\s+"
SOURCE_LANGUAGE_WORDS = (
    "que los las del por para con una este esta son ser como más sobre entre desde hasta cuando donde quien cual pero"
    " porque señor señores sociedad contrato presente mismo dicha dicho"
).split()


def _accent_table() -> tuple[str, str]:
    """Precomposed letters and the base letters their decompositions begin with."""
    pairs = []
    for code in range(0xC0, 0x2000):
        parts = unicodedata.normalize("NFD", chr(code))
        base = "".join(c for c in parts if unicodedata.category(c) != "Mn")
        if len(parts) > 1 and len(base) == 1:
            pairs.append((chr(code), base))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


ACCENTED, BASE = _accent_table()


def clean(text: Column) -> Column:
    """Without private-use and zero-width characters; null becomes empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"[{PRIVATE_USE}{ZERO_WIDTH}]", "")


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, "(?U)^\\s+|\\s+$", "")


def collapse(text: Column) -> Column:
    """Runs of white space of any kind become one space; trimmed."""
    return F.trim(F.regexp_replace(text, "(?U)\\s+", " "))


def clean_lines(text: Column) -> Column:
    """The lines of a text, each cleaned and collapsed: one pass over the whole text instead of one over each line."""
    spaced = F.regexp_replace(clean(text), "(?U)[\\s&&[^\\n]]+", " ")
    return F.split(F.trim(spaced), " ?\\n ?")


def strip_accents(text: Column) -> Column:
    return F.regexp_replace(F.translate(text, ACCENTED, BASE), "\\p{Mn}+", "")


def fold(text: Column) -> Column:
    """Without accents and case."""
    return F.replace(F.lower(strip_accents(text)), F.lit("ß"), F.lit("ss"))


def equal_folded(a: Column, b: Column) -> Column:
    return fold(a) == fold(b)


def norm_path(path: Column) -> Column:
    """Canonical relative path: forward slashes, none at the ends. Composed form is the caller's, see ``sources.paths``."""
    return F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), "^/+|/+$", "")


def join_path(root: Column, rel: Column) -> Column:
    return F.concat_ws("/", F.regexp_replace(root, "/+$", ""), norm_path(rel))


def cache_key(rel: Column, longest: int = 90) -> Column:
    """The last characters of a path with everything but letters and digits replaced."""
    return F.right(F.regexp_replace(rel, "[^\\p{L}\\p{N}]", "_"), F.lit(longest))


def color(packed: Column) -> Column:
    """24-bit colour as three shares."""
    return F.array(*((F.shiftright(packed, shift).bitwiseAND(F.lit(255)) / 255.0) for shift in (16, 8, 0)))


def is_bold(flags: Column, font: Column) -> Column:
    return (flags.bitwiseAND(F.lit(16)) != 0) | font.rlike("Bold|bold|Black|Heavy")


def is_italic(flags: Column, font: Column) -> Column:
    return (flags.bitwiseAND(F.lit(2)) != 0) | font.rlike("Italic|Oblique")


def translatable(text: Column) -> Column:
    """Whether a cell or node holds prose: letters in a row, not symbols only, not a formula."""
    bare = strip(F.coalesce(text, F.lit("")))
    return (bare != "") & ~bare.rlike(SYMBOLS_ONLY) & ~bare.rlike(FORMULA) & bare.rlike(f"[{LETTERS}]{{2,}}")


def is_prose_line(text: Column) -> Column:
    """Whether a collapsed line is worth extracting."""
    return (text != "") & text.rlike(f"[{LETTERS}]") & ~text.rlike(NUMBERS_ONLY) & ~text.isin(BULLETS)


def sheet_title(text: Column) -> Column:
    """A spreadsheet tab name: illegal characters become spaces, 31 characters at most."""
    return F.left(F.trim(F.regexp_replace(text, "[:\\\\/?*\\[\\]]", " ")), F.lit(31))


def retarget_references(formula: Column, renames: list[tuple[str, str]]) -> Column:
    """Sheet names in a formula, renamed in the order given; unquoted references only for plain names."""
    import re

    for old, new in renames:
        if old == new:
            continue
        formula = F.replace(formula, F.lit(f"'{old}'!"), F.lit(f"'{new}'!"))
        if re.fullmatch("[A-Za-z_][A-Za-z0-9_.]*", old):
            formula = F.regexp_replace(formula, f"(?<![A-Za-z0-9_'!]){re.escape(old)}!", re.sub(r"([\\$])", r"\\\1", new) + "!")
    return formula


def page_numbers(spec: Column) -> Column:
    """``1-5,11`` as sorted distinct 0-based numbers; blanks between commas are ignored."""
    parts = F.filter(F.transform(F.split(spec, ","), lambda p: F.trim(p)), lambda p: p != "")

    def run(part: Column) -> Column:
        first, last = (F.trim(F.regexp_extract(part, "^(\\d+)\\s*(?:-\\s*(\\d+))?$", i)).try_cast("int") for i in (1, 2))
        last = F.coalesce(last, first)
        return F.when(last >= first, F.sequence(first - 1, last - 1)).otherwise(F.array().cast("array<int>"))

    runs = F.transform(parts, run)
    return F.array_sort(F.array_distinct(F.flatten(runs)))


def classify_translation(source: Column, translated: Column) -> Column:
    """ok, failed (null or blank) or identical (unchanged although it holds source-language words)."""
    a, b = strip(source), strip(translated)
    words = f"(?iU)\\b({'|'.join(SOURCE_LANGUAGE_WORDS)})\\b"
    return F.when(b.isNull() | (b == ""), "failed").when((a == b) & a.rlike(words), "identical").otherwise("ok")


def numbers_in(text: Column) -> Column:
    """Digit sequences of a text as a sorted array, that is as a multiset."""
    return F.array_sort(F.regexp_extract_all(text, F.lit("(?U)\\b\\d[\\d.,]*\\b"), F.lit(0)))
