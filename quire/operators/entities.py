"""Protected entities: placeholders, fragments, the guard and verification."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.text import LETTERS, fold, numbers_in, strip, strip_accents

AMOUNTS = ["RD\\$[\\d.,]+", "US\\$[\\d.,]+", "\\$[\\d.,]+", "\\b\\d[\\d.,]*\\b"]
EDGE_SIGNS = '.,;:()"'
_PLACEHOLDER = "\\[\\[\\s*(\\d+)\\s*\\]\\]"


def without_accents(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", text) if unicodedata.category(c) != "Mn")


def spellings(entities: Iterable[str]) -> list[str]:
    """Entities with and without accents; longest first, then in code-point order, so that the choice among overlapping ones is fixed."""
    return sorted({s for e in entities for s in (e, without_accents(e))}, key=lambda s: (-len(s), s))


def protect_pattern(entities: Iterable[str]) -> str:
    """Java pattern of what must survive translation: entities without a letter or digit beside them, amounts and numbers."""
    found = "|".join(map(re.escape, spellings(entities)))
    guarded = [f"(?<![{LETTERS}0-9])(?:{found})(?![{LETTERS}0-9])"] if found else []
    return "(?iU)(" + "|".join(guarded + AMOUNTS) + ")"


def protect(text: Column, pattern: str) -> tuple[Column, Column]:
    """(text with ``[[k]]`` for the k-th match, the matches)."""
    tokens = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    parts = F.split(text, pattern, -1)
    marked = F.transform(parts, lambda part, i: F.concat(part, F.when(i < F.size(tokens), F.concat(F.lit("[["), i.cast("string"), F.lit("]]"))).otherwise("")))
    return F.array_join(marked, ""), tokens


def restore(text: Column, tokens: Column) -> Column:
    """Inverse of ``protect``; blanks inside the brackets are allowed, an index without token stays as it is written."""
    whole = F.regexp_extract_all(text, F.lit(_PLACEHOLDER), F.lit(0))
    index = F.regexp_extract_all(text, F.lit(_PLACEHOLDER), F.lit(1))
    parts = F.split(text, _PLACEHOLDER, -1)

    def filled(part: Column, i: Column) -> Column:
        token = F.get(tokens, F.get(index, i).try_cast("int"))
        return F.concat(part, F.coalesce(token, F.get(whole, i), F.lit("")))

    return F.array_join(F.transform(parts, filled), "")


def all_restored(text: Column) -> Column:
    return ~F.coalesce(text, F.lit("")).rlike("\\[\\[\\d+\\]\\]")


def bare_word(word: Column) -> Column:
    """Without accents, in capitals, without signs at the ends."""
    sign = re.escape(EDGE_SIGNS)
    return F.regexp_replace(F.upper(strip_accents(word)), f"^[{sign}]+|[{sign}]+$", "")


def name_fragments(entities: DataFrame, column: str = "entity") -> DataFrame:
    """Distinct (fragment): words of three and more letters of entities that have several words."""
    words = F.split(F.trim(F.regexp_replace(column, "(?U)\\s+", " ")), " ")
    found = entities.where(F.size(words) > 1).select(F.explode(words).alias("word"))
    return found.select(bare_word(F.col("word")).alias("fragment")).where("length(fragment) >= 3").distinct()


def fragment_words(entities: Iterable[str]) -> list[str]:
    """``name_fragments`` of a roster held as a list."""
    words = {without_accents(w).upper().strip(EDGE_SIGNS) for e in entities if len(e.split()) > 1 for w in e.split()}
    return sorted(w for w in words if len(w) >= 3)


def is_name_fragment(text: Column, entities: Iterable[str]) -> Column:
    return bare_word(F.regexp_replace(strip(text), "^[" + re.escape(EDGE_SIGNS) + "]+|[" + re.escape(EDGE_SIGNS) + "]+$", "")).isin(fragment_words(entities))


def is_wholly_protected(text: Column, entities: Iterable[str]) -> Column:
    """Whether a text names entities and leaves no word of three letters beside them.

    Entities are taken out longest first, then in code-point order.
    """
    names = sorted({without_accents(e).casefold() for e in entities if e.strip()}, key=lambda s: (-len(s), s))
    folded = fold(strip(text))
    if not names:
        return F.lit(False)
    found = F.exists(F.array(*map(F.lit, names)), lambda e: F.contains(folded, e))
    rest = F.aggregate(F.array(*map(F.lit, names)), folded, lambda left, e: F.replace(left, e, F.lit(" ")))
    return found & ~rest.rlike(f"[{LETTERS}]{{3,}}")


def is_guarded(text: Column, entities: Iterable[str]) -> Column:
    """Whether a text must never reach a translation backend."""
    entities = list(entities)
    return is_name_fragment(text, entities) | is_wholly_protected(text, entities)


def verified(source: Column, translated: Column, entities: Iterable[str]) -> Column:
    """Whether all entities that the source mentions, and exactly its numbers, are in the translation."""
    same_numbers = numbers_in(source) == numbers_in(translated)
    pattern = "|".join(map(re.escape, spellings(entities)))
    if not pattern:
        return same_numbers
    mentioned = F.transform(F.regexp_extract_all(source, F.lit(f"(?iU)({pattern})"), F.lit(1)), fold)
    folded = fold(translated)
    return F.forall(mentioned, lambda e: F.contains(folded, e)) & same_numbers


def denied(texts: DataFrame, terms: Iterable[str], column: str = "text") -> DataFrame:
    """Rows of ``texts`` that hold a term of a deny list, folded, with the terms they hold."""
    folded = fold(F.col(column))
    names = F.array(*(F.lit(without_accents(t).casefold()) for t in sorted(set(terms))))
    return texts.withColumn("terms", F.filter(names, lambda t: F.contains(folded, t))).where(F.size("terms") > 0)


def poisoned_entries(cache: DataFrame, entities: Iterable[str]) -> DataFrame:
    """Cache rows (source, en) whose source is a lone name fragment and whose translation differs from it."""
    changed = strip(F.coalesce("en", F.lit(""))) != strip(F.col("source"))
    return cache.where(is_name_fragment(F.col("source"), entities) & changed)
