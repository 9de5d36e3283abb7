"""Font names: families, styles and classes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Hints in family names, placeholder names, and the substitutes of each class.
MONO_HINTS = ["courier", "consolas", "mono"]
SERIF_HINTS = ["times", "georgia", "garamond", "book", "baskerville", "cambria", "roman", "serif", "antiqua", "bookman", "palatino", "century schoolbook"]
PLACEHOLDERS = ["glyph less font", "glyphlessfont", "glyphless"]
SYSTEM_SUBSTITUTE = {"mono": "courier new", "serif": "georgia", "sans": "arial"}
BUNDLED_SUBSTITUTE = {"mono": "monospace fallback", "serif": "serif fallback", "sans": "sans fallback"}
BOLD_NAME = "(?i)(bold|black|heavy|semibold|demibold)|(?<![a-z])bd(?![a-z])"
ITALIC_NAME = "(?i)(italic|oblique)|(?<![a-z])it(?![a-z])"
SUBSET_PREFIX = "^[A-Z]{6}\\+"
STYLE_SUFFIX = "(?i)-(Bold|Italic|Oblique|BoldItalic|BoldOblique|Regular|Roman|Light|Medium)+.*$"
VENDOR_SUFFIX = "(?i)(PSMT|PS-?|MT|Std|Pro)$"


def _normal(name: Column) -> Column:
    spaced = F.translate(name, "-_,", "   ")
    camel = F.when(F.contains(F.trim(spaced), F.lit(" ")), spaced).otherwise(F.regexp_replace(spaced, "(?<=[a-z])(?=[A-Z])", " "))
    return F.lower(F.trim(F.regexp_replace(camel, "\\s+", " ")))


def parse_font_name(name: Column) -> tuple[Column, Column, Column]:
    """(candidate families - the full name, then without style words -, bold, italic)."""
    bare = F.regexp_replace(F.coalesce(name, F.lit("")), SUBSET_PREFIX, "")
    base = F.trim(F.regexp_replace(F.regexp_replace(F.split_part(bare, F.lit(","), F.lit(1)), STYLE_SUFFIX, ""), VENDOR_SUFFIX, ""))
    base = F.regexp_replace(F.regexp_replace(base, BOLD_NAME, ""), ITALIC_NAME, "")
    candidates = F.array_distinct(F.filter(F.array(_normal(bare), _normal(base)), lambda c: c != ""))
    return candidates, bare.rlike(BOLD_NAME), bare.rlike(ITALIC_NAME)


def font_class(family: Column) -> Column:
    name = F.lower(family)
    return F.when(name.rlike("|".join(MONO_HINTS)), "mono").when(name.rlike("|".join(SERIF_HINTS)), "serif").otherwise("sans")


def base14(bold: Column, italic: Column, serif: Column) -> Column:
    """Built-in face of a style."""
    faces = {True: ("tibi", "tibo", "tiit", "tiro"), False: ("hebi", "hebo", "heit", "helv")}

    def pick(names: tuple[str, ...]) -> Column:
        return F.when(bold & italic, names[0]).when(bold, names[1]).when(italic, names[2]).otherwise(names[3])

    return F.when(serif, pick(faces[True])).otherwise(pick(faces[False]))
